"""Writers: partitioned Parquet, keep-last stores, GeoJSON, reports and appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import replace_where, upsert

# Key columns of the stores (fixed values).
METRIC_KEYS = ["model", "technology", "fold", "scale"]
OOF_KEYS = ["technology", "model", "ts"]
COVERAGE_KEYS = ["scope", "municipality", "technology", "model", "fold"]


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _fs(spark, path)
    return fs.exists(jpath)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Rename a staged folder into place; the old one goes last."""
    new, fs = _fs(spark, staged)
    here, _ = _fs(spark, path)
    old, _ = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(here)
    if had and not fs.rename(here, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, here):
        if had:
            fs.rename(old, here)
        raise OSError(f"cannot move {staged}")
    if had:
        fs.delete(old, True)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite through a staged folder, so a failed job leaves the old table."""
    staged = f"{path}.new-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(staged)
    swap(df.sparkSession, staged, path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def upsert_parquet(new: DataFrame, path: str, keys: list[str], order: str | None = None) -> None:
    """Keep-last upsert of a Parquet store; no rows, no change."""
    spark = new.sparkSession
    if new.isEmpty():
        return
    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    write_parquet(upsert(old, new, keys, order), path)


def replace_parquet(new: DataFrame, path: str, condition) -> None:
    """Rows that meet the condition make room for the new ones."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    write_parquet(replace_where(old, new, condition), path)


def write_geojson(rings: DataFrame, path: str) -> None:
    """One feature collection from ring vertices (name, kind, ring, pos, x, y); a name's rings form its polygon."""
    pts = rings.groupBy("name", "kind", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("pts"))
    closed = pts.withColumn("pts", F.concat("pts", F.slice("pts", 1, 1)))
    poly = closed.groupBy("name", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "pts"))), lambda r: r["pts"]).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("name", "kind").alias("properties"), F.struct(F.lit("Polygon").alias("type"), "coordinates").alias("geometry"))
    whole = poly.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_sort(F.collect_list(feature)).alias("features"))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, title: str, line) -> None:
    """A Markdown list: the title, then one line for each row."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, f"# {title}\n")], "ord int, value string")
    body = df.select(F.lit(1).alias("ord"), line.alias("value"))
    head.union(body).orderBy("ord", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def append_rows(df: DataFrame, path: str, migrate: bool = False) -> None:
    """Append to a Parquet log. Where the columns do not fit the log's, nothing is written and it raises; with ``migrate`` the
    log is rewritten once with the columns of both, missing values null."""
    spark = df.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        if [(f.name, f.dataType) for f in old.schema] != [(f.name, f.dataType) for f in df.schema]:
            if not migrate:
                raise ValueError(f"the columns of {path} are {old.schema.simpleString()}")
            write_parquet(old.unionByName(df, allowMissingColumns=True), path)
            return
    df.write.mode("append").parquet(path)


def merge_mapping(new: DataFrame, path: str, digits: int = 6) -> None:
    """Merge (key, values: map of numbers) into a JSON mapping: a new key's map replaces the old one's, numbers are rounded."""
    from .readers import read_mapping

    spark = new.sparkSession
    fresh = new.select("key", F.transform_values("values", lambda _, v: F.round(v.cast("double"), digits)).alias("values"))
    whole = upsert(read_mapping(spark, path), fresh, ["key"])
    staged = f"{path}.new-{uuid.uuid4().hex}"
    whole.write.json(staged)
    swap(spark, staged, path)
