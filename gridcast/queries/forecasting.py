"""Forecast bands, state totals, freshness and lead-time skill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import forecast
from .common import PAIR, rounded, t


def _quantiles(spark, d):
    li = t(spark, d, "lineitem")
    n = F.col("l_suppkey") % 18
    return li.groupBy(n.alias("district"), F.col("l_shipdate").alias("ts")).agg(F.avg(F.col("l_discount") * 5).alias("q10"), F.avg(F.col("l_quantity") / 60).alias("q50"), F.avg(F.col("l_tax") * 12).alias("q90")).withColumns({"cap_mw": F.col("district") + 5.0, "scale": F.lit(0.9), "offset": F.lit(-100.0), "conformal_q": F.when(F.col("district") % 3 == 0, 0.25).when(F.col("district") % 3 == 1, 0.0), "conformal_floor": F.lit(300.0)})


_Q = """q AS (SELECT l_suppkey % 18 AS district, l_shipdate AS ts, list_sort([avg(l_discount * 5), avg(l_quantity / 60), avg(l_tax * 12)]) AS q FROM lineitem GROUP BY 1, 2),
k AS (SELECT district, ts, greatest(0.9 * q[1] * (district + 5.0) * 1000 - 100, 0) AS lo, greatest(0.9 * q[2] * (district + 5.0) * 1000 - 100, 0) AS md, greatest(0.9 * q[3] * (district + 5.0) * 1000 - 100, 0) AS hi FROM q),
f AS (SELECT district, ts, CASE WHEN district % 3 = 0 THEN least(greatest(lo - 0.25 * greatest((hi - lo) / 2, 300), 0), md) ELSE lo END / 1000 AS lower_mw, md / 1000 AS median_mw, CASE WHEN district % 3 = 0 THEN greatest(hi + 0.25 * greatest((hi - lo) / 2, 300), md) ELSE hi END / 1000 AS upper_mw FROM k)"""
_COLS = ["lower_mw", "median_mw", "upper_mw"]


def forecast_band(spark, d):
    return rounded(forecast.downscale(_quantiles(spark, d)).select("district", "ts", *_COLS))


def state_aggregate(spark, d):
    return rounded(forecast.state_total(forecast.downscale(_quantiles(spark, d)), "ts", _COLS))


def district_energy(spark, d):
    return rounded(forecast.energy(forecast.downscale(_quantiles(spark, d)), ["district"], ["median_mw", "lower_mw"]))


def forecast_freshness(spark, d):
    runs = t(spark, d, "events").select("event_type", "ts")
    return rounded(forecast.freshness(runs, ["event_type"], "ts", F.lit("2024-01-31 02:00:00").cast("timestamp_ntz"), 3))


def lead_time_skill(spark, d):
    ev = t(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("ts")).agg(F.avg("value").alias("y"))
    runs = ev.select("ts", "y", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("lead")).select("ts", (F.col("ts") - F.make_dt_interval(hours="lead")).alias("issued_at"), (F.col("y") * 0.9 + F.col("lead")).alias("p"))
    return rounded(forecast.lead_time_errors(runs, ev))


def forecast_envelope(spark, d):
    f = forecast.downscale(_quantiles(spark, d))
    return forecast.envelope(f, ["district"], "ts", ["median_mw"])


def nation_energy(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    return rounded(o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("energy"), F.max("o_totalprice").alias("peak")), 4)


QUERIES = {
    "forecast_band": (forecast_band, f"WITH {_Q} SELECT district, ts, round(lower_mw, 6) AS lower_mw, round(median_mw, 6) AS median_mw, round(upper_mw, 6) AS upper_mw FROM f"),
    "state_aggregate": (state_aggregate, f"WITH {_Q} SELECT ts, round(sum(lower_mw), 6) AS lower_mw, round(sum(median_mw), 6) AS median_mw, round(sum(upper_mw), 6) AS upper_mw FROM f GROUP BY 1"),
    "district_energy": (district_energy, f"WITH {_Q} SELECT district, round(sum(median_mw + lower_mw), 6) AS energy_mwh, round(max(median_mw + lower_mw), 6) AS peak_mw FROM f GROUP BY 1"),
    "forecast_freshness": (forecast_freshness, "SELECT event_type, max(ts) AS last_run, round((epoch(TIMESTAMP '2024-01-31 02:00:00') - floor(epoch(max(ts)))) / 3600, 6) AS age_hours, (epoch(TIMESTAMP '2024-01-31 02:00:00') - floor(epoch(max(ts)))) / 3600 <= 3 AS fresh FROM events GROUP BY 1"),
    "lead_time_skill": (lead_time_skill, f"WITH e AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1), r AS (SELECT floor(k / 6)::BIGINT * 6 AS lead_hours, y, y * 0.9 + k AS p FROM e, range(1, 25) t(k)) SELECT lead_hours, {PAIR} FROM r GROUP BY 1"),
    "forecast_envelope": (forecast_envelope, None),
    "nation_energy": (nation_energy, "SELECT c_nationkey::BIGINT AS c_nationkey, round(sum(o_totalprice), 4) AS energy, round(max(o_totalprice), 4) AS peak FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
}
