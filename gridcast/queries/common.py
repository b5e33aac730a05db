"""Tables and stand-in series shared by the queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hour_floor


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Added before rounding, in units of two digits further: results that lie on a tie but for their last bit round alike in all engines.
NUDGE = "3.1e-"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines; integers widened."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((F.round(c + F.lit(float(f"{NUDGE}{digits + 2}")), digits) if kind == "double" else c.cast("bigint") if kind in ("int", "smallint", "tinyint") else c).alias(name))
    return df.select(*cols)


def nudged(sql: str) -> str:
    """The SQL with what it rounds to 4 to 6 digits shifted as ``rounded`` does."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        if tail := re.search(r", ([456])\)$", sql[m.end() : i]):
            out.append((m.end() + tail.start(), f" + {NUDGE}{int(tail[1]) + 2}::DOUBLE"))
    for place, text in sorted(out, reverse=True):
        sql = sql[:place] + text + sql[place:]
    return sql


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by event type and hour: (event_type, ts, y)."""
    ev = t(spark, sf_dir, "events")
    return ev.groupBy("event_type", hour_floor("ts").alias("ts")).agg(F.avg("value").alias("y"))


HOURLY = "h AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY ALL)"


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of order prices by day: (k, d, y)."""
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("y")).withColumn("k", F.lit(0))


DAILY = "daily AS (SELECT o_orderdate AS d, sum(o_totalprice) AS y FROM orders GROUP BY 1)"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as assets with derived coordinates: asset, lat, lon, kw, nation."""
    c = t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("asset"), (F.lit(51.3) + (k % 230) / 100.0).alias("lat"), (F.lit(11.3) + (k * 7 % 340) / 100.0).alias("lon"), F.abs("c_acctbal").alias("kw"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))


ASSETS = "assets AS (SELECT c_custkey AS asset, 51.3::DOUBLE + (c_custkey % 230) / 100.0::DOUBLE AS lat, 11.3::DOUBLE + (c_custkey * 7 % 340) / 100.0::DOUBLE AS lon, abs(c_acctbal) AS kw, c_nationkey AS nation, c_mktsegment AS segment FROM customer)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites: site, site_lat, site_lon."""
    s = t(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("site"), (F.lit(51.35) + (k * 11 % 220) / 100.0).alias("site_lat"), (F.lit(11.35) + (k * 13 % 330) / 100.0).alias("site_lon"))


SITES = "sites AS (SELECT s_suppkey AS site, 51.35::DOUBLE + (s_suppkey * 11 % 220) / 100.0::DOUBLE AS site_lat, 11.35::DOUBLE + (s_suppkey * 13 % 330) / 100.0::DOUBLE AS site_lon FROM supplier)"

PAIR = """count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(p - y), 6) AS mbe,
round(avg(abs(p - y)) / avg(abs(y)), 6) AS nmae, round(sqrt(avg((p - y) * (p - y))) / avg(abs(y)), 6) AS nrmse,
round(CASE WHEN count(*) >= 2 AND stddev_pop(y) >= 1e-9 AND stddev_pop(p) >= 1e-9 THEN covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)) END, 6) AS corr"""

HAVERSINE = "2 * {r} * atan2(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)), sqrt(1 - (pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
