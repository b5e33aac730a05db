"""Sources and sinks on the test tables: what is written to the shared folder and read back again."""

from __future__ import annotations

import json
import uuid
from urllib.parse import parse_qs

from pyspark.sql import functions as F

from ..operators import physics
from ..plans.checkpoint import shared_dir
from ..sources import readers, rest, stores, writers
from .common import rounded, t


def _path(spark, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def csv_round_trip(spark, d):
    path = _path(spark, "csv")
    writers.write_csv(t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return rounded(readers.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double"))


def xml_round_trip(spark, d):
    path = _path(spark, "xml")
    t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.format("xml").option("rowTag", "Unit").option("rootTag", "Units").save(path)
    rows = readers.read_xml(spark, path, "Unit", "s_suppkey string, s_name string, s_acctbal string")
    return rounded(rows.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")))


def geojson_round_trip(spark, d):
    path = _path(spark, "geojson")
    n = t(spark, d, "nation")
    corner = lambda i, x, y: F.struct(F.lit(i).alias("pos"), (F.col("n_nationkey") + x).cast("double").alias("x"), (F.col("n_regionkey") + y).cast("double").alias("y"))
    ring = F.explode(F.array(corner(0, 0, 0), corner(1, 2, 0), corner(2, 2, 1))).alias("p")
    writers.write_geojson(n.select(F.col("n_name").alias("name"), F.lit("area").alias("kind"), F.lit(0).alias("ring"), ring).select("name", "kind", "ring", "p.*"), path)
    return rounded(readers.read_geojson(spark, path).select("name", "kind", "ring", "pos", "x", "y"))


def store_upsert(spark, d):
    """A keep-last store in two runs, the second with new balances for every third key."""
    path = _path(spark, "store")
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    stores.upsert_store(c.filter("c_custkey % 2 = 0 OR c_custkey % 3 = 0"), path, ["c_custkey"])
    stores.upsert_store(c.filter("c_custkey % 3 <> 1").withColumn("c_acctbal", F.col("c_acctbal") + 1), path, ["c_custkey"])
    return rounded(stores.read_store(spark, path))


def store_replace(spark, d):
    path = _path(spark, "store")
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    stores.publish(s, path, ["s_suppkey"])
    stores.replace_store(s.filter("s_nationkey = 3").withColumn("s_acctbal", F.lit(0.0)), path, F.col("s_nationkey") == 3)
    return rounded(stores.read_store(spark, path))


def log_append(spark, d):
    """An append log whose second half has a column more."""
    path = _path(spark, "log")
    r = t(spark, d, "part").select("p_partkey", "p_size")
    writers.append_rows(r.filter("p_partkey % 2 = 0"), path)
    writers.append_rows(r.filter("p_partkey % 2 = 1").withColumn("note", F.lit("late")), path, migrate=True)
    return rounded(spark.read.parquet(path))


def mapping_merge(spark, d):
    """A map of coefficients, merged by a second run's, rounded to six digits."""
    path = _path(spark, "map")
    by = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key"))
    writers.merge_mapping(by.agg(F.map_from_arrays(F.array(F.lit("scale"), F.lit("offset")), F.array(F.avg("l_tax"), F.avg("l_discount"))).alias("values")), path)
    writers.merge_mapping(by.agg(F.map_from_arrays(F.array(F.lit("scale")), F.array(F.max("l_quantity").cast("double"))).alias("values")).filter("key < 'M'"), path)
    return rounded(readers.read_mapping(spark, path).select("key", F.explode("values").alias("name", "value")))


def report_lines(spark, d):
    path = _path(spark, "report")
    writers.write_report(t(spark, d, "region"), path, "Regions", F.format_string("- %s: %d", "r_name", "r_regionkey"))
    return spark.read.text(path)


def _hours(spark, d):
    """Mean value by hour for each node, which is a number that users share modulo the nations."""
    ev = t(spark, d, "events")
    return ev.groupBy((F.col("user_id") % 25).cast("int").alias("node"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("h")).agg(F.avg("value").alias("t"))


def _replies(spark, d):
    """What a weather service would reply for each node, kept in a shared folder as JSON that ``replay`` serves."""
    path = _path(spark, "replies")
    hours = F.array_sort(F.collect_list(F.struct("h", "t")))
    reply = F.struct(F.transform(hours, lambda x: F.date_format(x["h"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.transform(hours, lambda x: x["t"]).alias("t"))
    _hours(spark, d).groupBy((F.col("node") + 510).alias("lat")).agg(F.to_json(reply).alias("value")).repartition("lat").write.partitionBy("lat").text(path)
    return path


def replay(url: str):
    """The kept replies of the asked nodes, of the asked days."""
    from pyarrow import fs

    base, _, query = url.partition("?")
    q = {k: v[0] for k, v in parse_qs(query).items()}
    files, folder = fs.FileSystem.from_uri(base) if ":" in base else (fs.LocalFileSystem(), base)
    out = []
    for lat in q["latitude"].split(","):
        found = files.get_file_info(fs.FileSelector(f"{folder}/lat={round(float(lat) * 10)}", allow_not_found=True))
        text = "".join(files.open_input_stream(i.path).read().decode() for i in found if i.base_name.startswith("part-"))
        held = json.loads(text) if text else {"time": []}
        own = [i for i, h in enumerate(held["time"]) if q["start_date"] <= h[:10] <= q["end_date"]]
        out.append({"hourly": {k: [v[i] for i in own] for k, v in held.items()}})
    return out


def weather_rest(spark, d):
    """A month of all nodes from a service that replays kept replies: batches of five nodes, two lanes, five requests."""
    rest.register(spark)
    nodes = t(spark, d, "nation").select(F.concat_ws(":", F.lit(510) + F.col("n_nationkey"), F.lit(110) + F.col("n_regionkey")).alias("n"))
    named = ",".join(r["n"] for r in nodes.collect())  # a registry of nodes
    how = {"nodes": named, "variables": "t", "start": "2024-01-01", "end": "2024-01-31", "batch": "5", "lanes": "2", "budget": "5", "url": _replies(spark, d), "transport": "gridcast.queries.stores:replay"}
    return rounded(spark.read.format("gridcast_weather").options(**how).load())


def store_extension(spark, d):
    """A weather store that ends in the middle of the month (with preliminary values), extended to its end: each node from its own last day on."""
    path = _path(spark, "weather")
    old = _hours(spark, d).filter("h < timestamp_ntz'2024-01-16 00:00:00'").select((F.col("node") + 510).alias("node_lat"), F.lit(110).alias("node_lon"), F.col("h").alias("ts"), F.lit(-1.0).alias("t"))
    stores.publish(old, path, rest.NODE_KEYS)
    rest.extend_store(spark, path, {"variables": "t", "batch": "5", "url": _replies(spark, d), "transport": "gridcast.queries.stores:replay"}, "2024-01-31")
    return rounded(stores.read_store(spark, path))


def newest_run(spark, d):
    """Of runs written under names that sort by time, the newest."""
    path = _path(spark, "runs")
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for k, stamp in enumerate(("20240101T0000", "20240103T0600", "20240102T1200")):
        writers.write_parquet(o.filter(F.col("o_orderkey") % 3 == k), f"{path}/run_{stamp}.parquet")
    return readers.read_newest(spark, f"{path}/run_*.parquet")


def text_digests(spark, d):
    path = _path(spark, "text")
    t(spark, d, "region").orderBy("r_regionkey").coalesce(1).select("r_name").write.text(path)
    return readers.file_digests(spark, f"{path}/part-*").select("sha256")


def totals_on_map(spark, d):
    """Totals by district beside the vertices of the district's outline."""
    n = t(spark, d, "nation")
    rings = n.select(F.col("n_name").alias("name"), F.lit(0).alias("ring"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    totals = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.sum("c_acctbal").alias("total"))
    return rounded(readers.attach_totals(rings, totals), 4)


def weather_with_geometry(spark, d):
    """Hourly weather of clusters on the hours for which there is geometry (half of them)."""
    ev = t(spark, d, "events").select("event_type", F.date_trunc("hour", "ts").alias("ts"), "value")
    weather = ev.groupBy(F.col("event_type").alias("cluster_id"), "ts").agg(F.avg("value").alias("ghi"))
    geometry = weather.filter(F.hour("ts") % 2 == 0).select("cluster_id", "ts", F.hour("ts").cast("double").alias("zenith"))
    return rounded(physics.with_geometry(weather, geometry))


_N = "(SELECT n_nationkey, n_regionkey, n_name FROM nation)"
QUERIES = {
    "csv_round_trip": (csv_round_trip, "SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer"),
    "xml_round_trip": (xml_round_trip, "SELECT s_suppkey, s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier"),
    "geojson_round_trip": (geojson_round_trip, f"SELECT n_name AS name, 'area' AS kind, 0::BIGINT AS ring, i::BIGINT AS pos, round(n_nationkey + x, 6)::DOUBLE AS x, round(n_regionkey + y, 6)::DOUBLE AS y FROM {_N}, (VALUES (0, 0, 0), (1, 2, 0), (2, 2, 1)) v(i, x, y)"),
    "store_upsert": (store_upsert, "SELECT c_custkey, round(c_acctbal + CASE WHEN c_custkey % 3 <> 1 THEN 1 ELSE 0 END, 6) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 1"),
    "store_replace": (store_replace, "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, round(CASE WHEN s_nationkey = 3 THEN 0 ELSE s_acctbal END, 6) AS s_acctbal FROM supplier"),
    "log_append": (log_append, "SELECT p_partkey, p_size::BIGINT AS p_size, CASE WHEN p_partkey % 2 = 1 THEN 'late' END AS note FROM part"),
    "mapping_merge": (mapping_merge, "WITH m AS (SELECT l_returnflag AS key, avg(l_tax) AS a, avg(l_discount) AS b, max(l_quantity)::DOUBLE AS c FROM lineitem GROUP BY 1) SELECT key, 'scale' AS name, round(CASE WHEN key < 'M' THEN c ELSE a END, 6) AS value FROM m UNION ALL SELECT key, 'offset', round(b, 6) FROM m WHERE key >= 'M'"),
    "report_lines": (report_lines, "SELECT unnest(['# Regions', '']) AS value UNION ALL SELECT '- ' || r_name || ': ' || r_regionkey FROM region"),
    "weather_rest": (weather_rest, "SELECT (510 + n_nationkey)::BIGINT AS node_lat, (110 + n_regionkey)::BIGINT AS node_lon, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M') AS ts, round(avg(value), 6) AS t FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY 1, 2, 3"),
    "store_extension": (store_extension, "WITH e AS (SELECT user_id % 25 AS k, date_trunc('hour', ts) AS h, avg(value) AS t FROM events GROUP BY 1, 2), l AS (SELECT k, date_trunc('day', max(h)) AS d FROM e WHERE h < TIMESTAMP '2024-01-16' GROUP BY 1) SELECT (510 + k)::BIGINT AS node_lat, 110::BIGINT AS node_lon, h AS ts, round(CASE WHEN h < d THEN -1.0::DOUBLE ELSE t END, 6) AS t FROM e JOIN l USING (k)"),
    "newest_run": (newest_run, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 1"),
    "text_digests": (text_digests, "SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS sha256 FROM region"),
    "totals_on_map": (totals_on_map, f"SELECT n_name AS name, 0::BIGINT AS ring, pos::BIGINT AS pos, round(total, 4) AS total FROM {_N} LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) AS total FROM customer GROUP BY 1) ON c_nationkey = n_nationkey, range(3) r(pos)"),
    "weather_with_geometry": (weather_with_geometry, "SELECT event_type AS cluster_id, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS ghi, hour(date_trunc('hour', any_value(ts)))::DOUBLE AS zenith FROM events WHERE hour(ts) % 2 = 0 GROUP BY 1, 2"),
}
