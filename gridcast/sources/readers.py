"""Readers for quirky CSV, registry XML, GeoJSON, weather payloads, curves and configuration."""

from __future__ import annotations

import json
import re
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import decimal_comma


def read_csv(spark: SparkSession, path: str, schema: str, quote: str = '"') -> DataFrame:
    """Header CSV with a declared schema; no inference pass."""
    return spark.read.csv(path, header=True, schema=schema, quote=quote)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-16LE", skip: int = 4) -> DataFrame:
    """(file, line, text) of text files in any encoding, in file order, without the first ``skip`` lines and empty ones.

    Spark's text readers split UTF-16 wrongly and cannot skip lines; these files are small (one per year), so each is read whole.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", encoding), "^﻿", "")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(F.split(text, "\r?\n"))).filter((F.col("pos") >= skip) & (F.trim("col") != "")).select("file", F.col("pos").alias("line"), F.col("col").alias("text"))


def read_grid_actuals(spark: SparkSession, path: str, value: str, name: str, encoding: str = "UTF-16LE", years: tuple[int, int] = (2022, 2026)) -> DataFrame:
    """(file, line, local, {name}) of semicolon files: date, from, to and a value column.

    The header's names are stripped; the value column is the one named ``value``, else the first that holds "onshore". Files are
    kept by the year in their name. Raises in the plan where a file has no value column.
    """
    lines = read_lines(spark, path, encoding)
    year = F.regexp_extract("file", r"(\d{4})", 1).try_cast("int")
    lines = lines.filter(year.between(*years))
    cells = lines.withColumn("cells", F.transform(F.split("text", ";"), lambda c: F.trim(c)))
    first = F.min_by("cells", "line").over(Window.partitionBy("file"))
    top = F.min("line").over(Window.partitionBy("file"))
    head = cells.withColumns({"_head": first, "_top": top})
    exact = F.array_position(F.transform("_head", lambda c: F.lower(c)), value.lower())
    alike = F.array_position(F.transform("_head", lambda c: F.contains(F.lower(c), F.lit("onshore"))), True)
    at = F.when(exact > 0, exact).when(alike > 0, alike)
    checked = F.assert_true(at.isNotNull(), F.concat(F.lit("no value column in "), F.col("file")))
    start = F.array_position(F.transform("_head", lambda c: F.lower(c)), "von")
    rows = head.filter(checked.isNull()).filter("line > _top").withColumns({"_at": at.cast("int"), "_von": start.cast("int")})
    local = F.try_to_timestamp(F.concat_ws(" ", F.try_element_at("cells", F.lit(1)), F.try_element_at("cells", F.col("_von"))), F.lit("dd.MM.yyyy HH:mm")).cast("timestamp_ntz")
    return rows.select("file", "line", local.alias("local"), decimal_comma(F.try_element_at("cells", F.col("_at"))).alias(name)).filter("local IS NOT NULL")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Records of a registry export, as text columns."""
    return spark.read.format("xml").option("rowTag", row_tag).option("charset", encoding).schema(schema).load(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, poly, ring, pos, x, y): the ring vertices of polygons and multipolygons, without the closing vertex."""
    ring = "array<array<array<double>>>"
    feature = "struct<properties:struct<name:string,kind:string>,geometry:struct<type:string,coordinates:string>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>").features).alias("f"))
    multi = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(F.col("f.geometry.coordinates"), f"array<{ring}>")).otherwise(F.array(F.from_json(F.col("f.geometry.coordinates"), ring)))
    rings = rows.select(F.col("f.properties.name").alias("name"), F.col("f.properties.kind").alias("kind"), F.posexplode(F.flatten(multi)).alias("ring", "pts"))
    pts = rings.select("name", "kind", F.col("name").alias("poly"), "ring", F.size("pts").alias("_n"), F.posexplode("pts").alias("pos", "pt"))
    return pts.filter("pos < _n - 1").select("name", "kind", "poly", "ring", "pos", F.col("pt")[0].alias("x"), F.col("pt")[1].alias("y"))


def read_node_files(spark: SparkSession, path: str) -> DataFrame:
    """Weather tables named ``node_{lat}_{lon}``: the coordinates of the name as integers in tenths of a degree."""
    rows = spark.read.parquet(path)
    name = F.col("_metadata.file_path")
    part = lambda i: F.rint(F.regexp_extract(name, r"node_(-?[\d.]+)_(-?[\d.]+?)(?:\.parquet|/|$)", i).cast("double") * 10).cast("int")
    return rows.select("*", part(1).alias("node_lat"), part(2).alias("node_lon"))


def explode_hourly(payload: DataFrame, json_col: str, keys: list[str], variables: list[str]) -> DataFrame:
    """Columnar hourly JSON (``{"hourly": {"time": [...], var: [...]}}``) to one row an hour; payloads without times vanish."""
    fields = ",".join(["time:array<string>", *[f"{v}:array<double>" for v in variables]])
    parsed = payload.select(*keys, F.from_json(json_col, f"struct<hourly:struct<{fields}>>").hourly.alias("h"))
    zipped = F.arrays_zip(F.col("h.time").alias("time"), *[F.col(f"h.{v}").alias(v) for v in variables])
    rows = parsed.filter(F.size("h.time") > 0).select(*keys, F.explode(zipped).alias("r"))
    return rows.select(*keys, F.to_timestamp_ntz(F.replace(F.col("r.time"), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm")).alias("ts"), *[F.col(f"r.{v}").alias(v) for v in variables])


#: The schema of a meter reading.
METER = "struct<timestamp:struct<end:bigint>,feedIn:struct<total:double,list:array<struct<name:string,usage:double>>>,consumptions:struct<list:array<struct<name:string,usage:double>>>,autarky:double,dailyCo2Savings:double>"


def usage(items: Column, name: str) -> Column:
    """The usage of a named list item, 0 where it is missing."""
    pairs = F.map_from_entries(F.transform(F.coalesce(items, F.array().cast("array<struct<name:string,usage:double>>")), lambda x: F.struct(x["name"], x["usage"])))
    return F.coalesce(F.try_element_at(pairs, F.lit(name)), F.lit(0.0))


def flatten_meter(df: DataFrame, json_col: str, keys: list[str], now: Column, feeds: tuple[str, ...] = ("biomass", "solar", "wind", "other"), uses: tuple[str, ...] = ("industry", "public", "households")) -> DataFrame:
    """Telemetry columns of meter JSON: a total of zero becomes the sum of the parts, an end of zero becomes ``now``, kg become tons."""
    m = df.filter(F.col(json_col).isNotNull()).select(*keys, F.from_json(json_col, METER).alias("m"))  # a poll that failed has none
    end = F.coalesce(F.nullif(F.col("m.timestamp.end"), F.lit(0)), F.unix_seconds(now))
    parts = [usage(F.col("m.feedIn.list"), f).alias(f) for f in feeds]
    rows = m.select(*keys, F.timestamp_seconds(end).alias("ts"), *parts, *[usage(F.col("m.consumptions.list"), u).alias(u) for u in uses], F.coalesce("m.feedIn.total", F.lit(0.0)).alias("_total"), F.coalesce("m.autarky", F.lit(0.0)).alias("autarky"), (F.coalesce("m.dailyCo2Savings", F.lit(0.0)) / 1000).alias("co2_tons"))
    total = F.when(F.col("_total") == 0, sum((F.col(f) for f in feeds[1:]), F.col(feeds[0]))).otherwise(F.col("_total"))
    return rows.withColumn("regional_total", total).withColumn("solar_share", F.coalesce(F.try_divide(F.col("solar"), F.col("regional_total")), F.lit(0.0)) * 100).drop("_total")


def read_config(path: str) -> dict:
    """A JSON or (where PyYAML is installed) YAML mapping on the driver; raises where it is missing or no mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if re.search(r"\.ya?ml$", path):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, values) of JSON lines, each a key with a map of numbers; none where the path is missing."""
    from .writers import exists

    if not exists(spark, path):
        return spark.createDataFrame([], "key string, values map<string, double>")
    return spark.read.schema("key string, values map<string, double>").json(path)


def read_newest(spark: SparkSession, pattern: str) -> DataFrame:
    """The Parquet table of the last name among those that match: names carry the time of issue in sortable form."""
    found = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    held = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    if not len(held):
        raise FileNotFoundError(pattern)
    return spark.read.parquet(max((x.getPath() for x in held), key=lambda x: x.getName()).toString())


def attach_totals(rings: DataFrame, totals: DataFrame, name: str = "name") -> DataFrame:
    """Outlines with the totals of their feature, by name; an outline without totals keeps nulls."""
    return rings.join(totals, name, "left")


def read_way_edges(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(poly, x1, y1, x2, y2) from the ways of a boundary relation's JSON: even-odd crossing needs no assembled rings."""
    kind = "struct<elements:array<struct<members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>>>"
    ways = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind).elements).alias("e")).select(F.explode("e.members").alias("m")).filter("m.type = 'way'")
    pts = F.col("m.geometry")
    pairs = F.arrays_zip(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))).alias("a"), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))).alias("b"))
    edge = ways.select(F.explode(pairs).alias("p"))
    return edge.select(F.lit(name).alias("poly"), F.col("p.a.lon").alias("x1"), F.col("p.a.lat").alias("y1"), F.col("p.b.lon").alias("x2"), F.col("p.b.lat").alias("y2")).filter("y1 <> y2")


def read_ways(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(poly, role, way, pos, x, y): the vertices of the ways of a boundary relation's JSON, numbered in its order; ``outlines.assemble`` makes rings of them."""
    kind = "struct<elements:array<struct<members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>>>"
    members = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).elements.alias("e")).select(F.posexplode(F.flatten("e.members")).alias("way", "m"))
    ways = members.filter("m.type = 'way'").select(F.col("way").cast("long").alias("way"), F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"), F.posexplode("m.geometry").alias("pos", "p"))
    return ways.select(F.lit(name).alias("poly"), "role", "way", "pos", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))


def fetch_boundaries(get, url: str, names: dict[str, int], path: str) -> dict[str, str]:
    """Fetch each relation's boundary once by ``get`` (from URL to parsed JSON) and keep it as ``{path}/{name}.json``; returns the files by name.

    What was fetched before is not fetched again. A reply without elements raises, and leaves no file.
    """
    found = {}
    for name, relation in names.items():
        file = Path(path) / f"{quote(name, safe=' ')}.json"
        if not file.exists():
            reply = get(f"{url}?data={quote(f'[out:json][timeout:180];relation({int(relation)});out geom;')}")
            if not reply.get("elements"):
                raise ValueError(f"no outline of {name} ({relation})")
            file.parent.mkdir(parents=True, exist_ok=True)
            staged = file.with_suffix(".new")
            staged.write_text(json.dumps(reply), encoding="utf-8")
            staged.replace(file)
        found[name] = str(file)
    return found


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of binary artefacts."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
