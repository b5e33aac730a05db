"""Resampling, gaps, lags, windows and metrics over series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hour_floor
from ..operators import clean, timeseries
from ..plans import folds, matrix, metrics
from .common import HOURLY, PAIR, hourly, rounded, t

TYPES = ["click", "error", "purchase", "signup", "view"]


def hourly_resample(spark, d):
    return rounded(timeseries.resample_mean(t(spark, d, "events"), ["event_type"], "ts", ["value"]))


def _gappy(spark, d):
    full = timeseries.resample_mean(t(spark, d, "events"), ["event_type"], "ts", ["value"])
    hole = (F.hour("ts") % 5).isin(1, 2) | (F.day("ts") % 6 == 0)
    return full.withColumn("value", F.when(~hole, F.col("value")))


GAPPY = """b AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY ALL),
s AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY 1),
g AS (SELECT s.event_type, s.ts, CASE WHEN hour(ts) % 5 NOT IN (1, 2) AND day(ts) % 6 <> 0 THEN v END AS y FROM s LEFT JOIN b USING (event_type, ts))"""


def short_gap_interpolation(spark, d):
    return rounded(timeseries.interpolate_gaps(_gappy(spark, d), ["event_type"], "ts", "value", 3).select("event_type", "ts", "value"))


def telemetry_dedup_first(spark, d):
    ev = t(spark, d, "events").withColumn("hour", hour_floor("ts"))
    return clean.keep_first(ev, ["user_id", "hour"], "ts", "event_id").select("user_id", "hour", "event_id", "value")


def upsert_keep_last(spark, d):
    ev = t(spark, d, "events")
    new = ev.filter("value > 50").withColumn("value", F.col("value") * 2)
    return clean.upsert(ev, new, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


def replace_by_filter(spark, d):
    ev = t(spark, d, "events").select("event_id", "event_type", "value")
    return clean.replace_where(ev, ev.filter("event_type = 'view' AND value > 50").withColumn("event_type", F.lit("view2")), F.col("event_type") == "view")


def persistence_metrics(spark, d):
    h = hourly(spark, d)
    return rounded(metrics.errors(timeseries.lag_by_time(h, ["event_type"], "ts", "y", name="p"), ["event_type"]))


def persistence_positional(spark, d):
    h = hourly(spark, d)
    return rounded(metrics.errors(timeseries.lag_by_rows(h, ["event_type"], "ts", "y", 24, "p"), ["event_type"]))


def climatology_predict(spark, d):
    h = hourly(spark, d).withColumns({"hour": F.hour("ts"), "dow": F.weekday("ts")})
    cut = F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")
    fitted = folds.climatology(h.filter(F.col("ts") < cut), ["event_type"], ["hour", "dow"], "y", "p")
    return rounded(metrics.errors(folds.climatology_predict(h.filter(F.col("ts") >= cut), fitted, ["event_type"], ["hour", "dow"]), ["event_type"]))


def climatology_fit(spark, d):
    h = hourly(spark, d).withColumns({"hour": F.hour("ts"), "month": F.month("ts")})
    return rounded(folds.climatology(h, ["event_type"], ["hour", "month"], "y"))


def _pairs(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.9).alias("p"))


def error_metrics(spark, d):
    return rounded(metrics.errors(_pairs(spark, d), ["l_returnflag"]))


def interval_metrics(spark, d):
    li = t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y"), (F.col("l_discount") * 200).alias("lo"), (F.col("l_discount") * 200 + 25).alias("hi"))
    return rounded(metrics.intervals(li, ["l_returnflag"]))


def r2_scores(spark, d):
    return rounded(metrics.r2(_pairs(spark, d), ["l_returnflag", "l_linestatus"]))


def metric_rows(spark, d):
    li = t(spark, d, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("fold"), (F.col("l_quantity") / 50).alias("y_cf"), (F.col("l_discount") * 10).alias("pred_cf"), (F.col("l_tax") * 100 + 10).alias("cap_mw"))
    li = li.withColumn("y_mw", F.col("y_cf") * F.col("cap_mw"))
    return rounded(metrics.metric_rows(li, ["l_returnflag", "fold"]))


def hourly_bias_pivot(spark, d):
    ev = t(spark, d, "events").withColumn("e", F.col("value") - 50)
    return rounded(ev.groupBy(F.hour("ts").alias("hour")).pivot("event_type", TYPES).agg(F.avg("e")))


def rolling_metrics_48h(spark, d):
    h = timeseries.lag_by_time(hourly(spark, d), ["event_type"], "ts", "y", name="p")
    return rounded(metrics.rolling(h, ["event_type"]).select("event_type", "window_start", "n", "mae", "rmse", "mbe", "nmae"))


def busiest_window(spark, d):
    h = hourly(spark, d).groupBy("ts").pivot("event_type", ["click", "view"]).agg(F.first("y")).withColumn("k", F.lit(0)).dropna()
    return rounded(timeseries.busiest_window(h, ["k"], "ts", ["click", "view"], 120))


def cyclical_features(spark, d):
    return rounded(matrix.calendar(t(spark, d, "events").select("event_id", "ts")))


def sequence_windows(spark, d):
    h = timeseries.sequence_windows(hourly(spark, d), ["event_type"], "ts", ["y"], 24)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0])
    return rounded(h.select("event_type", "ts", F.size("window").alias("n"), total.alias("total"), F.col("window")[0][0].alias("oldest"), F.col("window")[23][0].alias("newest")))


def calibration_split(spark, d):
    h = timeseries.prefix_split(hourly(spark, d), ["event_type"], "ts", 0.4)
    return rounded(h.groupBy("event_type", "fit").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("y").alias("mean_y")))


def dst_localize(spark, d):
    # Files of 96 quarter hours of the day on which clocks go back.
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select(F.floor(k / 96).alias("file"), (k % 96).alias("line"), (F.lit("2024-10-27 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(k % 96 * 15).cast("int"))).alias("utc"))
    local = o.select("file", "line", F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), "utc").alias("local"))
    return timeseries.localize(local, ["file"], "local", "line").select("file", "line", "local", "ts")


def local_grid(spark, d):
    g = timeseries.local_grid(t(spark, d, "region"), "2024-03-30 00:00:00", "2024-04-01 00:00:00")
    return g


def session_gaps(spark, d):
    return timeseries.sessions(t(spark, d, "events"), ["user_id"], "ts", "12 hours")


def tumbling_15m(spark, d):
    ev = t(spark, d, "events")
    return rounded(ev.groupBy("event_type", F.window("ts", "15 minutes").start.alias("ts")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))


def sliding_48h(spark, d):
    ev = t(spark, d, "events")
    return rounded(ev.groupBy("event_type", F.window("ts", "48 hours", "24 hours").start.alias("ts")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))


def running_maximum(spark, d):
    h = hourly(spark, d).withColumn("y", F.when(F.hour("ts") % 7 != 0, F.col("y")))
    return rounded(h.withColumn("top", timeseries.cumulative_max("y", ["event_type"], "ts")))


def lag_covariance(spark, d):
    w = Window.partitionBy("event_type").orderBy("ts")
    c = hourly(spark, d).withColumn("c", F.col("y") - F.avg("y").over(Window.partitionBy("event_type")))
    lags = c.select("event_type", *[(F.col("c") * (F.lag("c", k).over(w) if k else F.col("c"))).alias(f"x{k}") for k in range(6)]).select("event_type", F.posexplode(F.array(*[f"x{k}" for k in range(6)])).alias("lag", "x"))
    return rounded(lags.groupBy("event_type", "lag").agg(F.avg("x").alias("gamma")))


def horizon_24h(spark, d):
    from ..plans import forecast

    return rounded(forecast.horizon(hourly(spark, d), ["event_type"], "ts", F.lit("2024-01-15 10:20:00").cast("timestamp_ntz")))


def meter_ceil(spark, d):
    from ..functions import hour_ceil

    return t(spark, d, "events").select("event_id", hour_ceil("ts").alias("hour"))


QUERIES = {
    "hourly_resample": (hourly_resample, "WITH b AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY 1) SELECT s.event_type, s.ts, round(v, 6) AS value FROM s LEFT JOIN b USING (event_type, ts)"),
    "short_gap_interpolation": (short_gap_interpolation, f"""WITH {GAPPY},
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn, count(y) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM g),
m AS (SELECT *, count(*) OVER (PARTITION BY event_type, grp) - 1 AS len, first_value(y) OVER (PARTITION BY event_type, grp ORDER BY rn) AS p, rn - min(rn) OVER (PARTITION BY event_type, grp) AS k FROM n),
x AS (SELECT m.*, nx.p AS nxt FROM m LEFT JOIN (SELECT event_type, grp, min(p) AS p FROM m GROUP BY ALL) nx ON nx.event_type = m.event_type AND nx.grp = m.grp + 1)
SELECT event_type, ts, round(CASE WHEN y IS NOT NULL THEN y WHEN grp > 0 AND nxt IS NOT NULL AND len <= 3 THEN p + (nxt - p) * k / (len + 1) END, 6) AS value FROM x"""),
    "telemetry_dedup_first": (telemetry_dedup_first, "SELECT user_id, hour, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY ts, event_id) AS rn FROM (SELECT *, date_trunc('hour', ts) AS hour FROM events)) WHERE rn = 1"),
    "upsert_keep_last": (upsert_keep_last, "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY side DESC, event_id DESC) AS rn FROM (SELECT *, 0 AS side FROM events UNION ALL SELECT * REPLACE (value * 2 AS value), 1 AS side FROM events WHERE value > 50)) WHERE rn = 1"),
    "replace_by_filter": (replace_by_filter, "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, 'view2', value FROM events WHERE event_type = 'view' AND value > 50"),
    "persistence_metrics": (persistence_metrics, f"WITH {HOURLY} SELECT event_type, {PAIR} FROM (SELECT a.event_type, a.y, b.y AS p FROM h a JOIN h b ON a.event_type = b.event_type AND b.ts = a.ts - INTERVAL 24 HOUR) GROUP BY 1"),
    "persistence_positional": (persistence_positional, f"WITH {HOURLY} SELECT event_type, {PAIR} FROM (SELECT event_type, y, lag(y, 24) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM h) WHERE p IS NOT NULL GROUP BY 1"),
    "climatology_predict": (climatology_predict, f"WITH {HOURLY}, f AS (SELECT event_type, hour(ts) AS hr, isodow(ts) AS dw, avg(y) AS p FROM h WHERE ts < TIMESTAMP '2024-01-21' GROUP BY ALL) SELECT h.event_type, {PAIR} FROM h JOIN f ON f.event_type = h.event_type AND hr = hour(ts) AND dw = isodow(ts) WHERE ts >= TIMESTAMP '2024-01-21' GROUP BY 1"),
    "climatology_fit": (climatology_fit, f"WITH {HOURLY} SELECT event_type, hour(ts) AS hour, month(ts) AS month, round(avg(y), 6) AS climatology FROM h GROUP BY ALL"),
    "error_metrics": (error_metrics, f"SELECT l_returnflag, {PAIR} FROM (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 1.9::DOUBLE AS p FROM lineitem) GROUP BY 1"),
    "interval_metrics": (interval_metrics, "SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS picp, round(avg(hi - lo) / avg(abs(y)), 6) AS mpiw FROM (SELECT l_returnflag, l_quantity AS y, l_discount * 200 AS lo, l_discount * 200 + 25 AS hi FROM lineitem) GROUP BY 1"),
    "r2_scores": (r2_scores, "SELECT l_returnflag, l_linestatus, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, round(pow(covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)), 2), 6) AS corr2 FROM (SELECT l_returnflag, l_linestatus, l_extendedprice / 1000 AS y, l_quantity * 1.9::DOUBLE AS p FROM lineitem) GROUP BY 1, 2"),
    "metric_rows": (metric_rows, f"WITH x AS (SELECT l_returnflag, year(l_shipdate) AS fold, l_quantity / 50 AS y_cf, l_discount * 10 AS pred_cf, l_tax * 100 + 10 AS cap FROM lineitem), u AS (SELECT l_returnflag, fold, 'cf' AS scale, y_cf AS y, pred_cf AS p FROM x UNION ALL SELECT l_returnflag, fold, 'mw', y_cf * cap, pred_cf * cap FROM x) SELECT l_returnflag, fold, scale, {PAIR} FROM u GROUP BY 1, 2, 3"),
    "hourly_bias_pivot": (hourly_bias_pivot, "SELECT hour(ts) AS hour, " + ", ".join(f"round(avg(value - 50) FILTER (event_type = '{x}'), 6) AS {x}" for x in TYPES) + " FROM events GROUP BY 1"),
    "rolling_metrics_48h": (rolling_metrics_48h, f"""WITH {HOURLY}, x AS (SELECT a.event_type, a.ts, a.y, b.y AS p FROM h a JOIN h b ON a.event_type = b.event_type AND b.ts = a.ts - INTERVAL 24 HOUR),
w AS (SELECT event_type, unnest(generate_series(min(ts), max(ts) + INTERVAL 1 HOUR - INTERVAL 48 HOUR, INTERVAL 24 HOUR)) AS window_start FROM x GROUP BY 1)
SELECT event_type, window_start, n, mae, rmse, mbe, nmae FROM (SELECT w.event_type, window_start, {PAIR} FROM w JOIN x ON x.event_type = w.event_type AND ts >= window_start AND ts < window_start + INTERVAL 48 HOUR GROUP BY 1, 2) WHERE n >= 12"""),
    "busiest_window": (busiest_window, f"""WITH {HOURLY}, p AS (SELECT ts, first(y) FILTER (event_type = 'click') AS a, first(y) FILTER (event_type = 'view') AS b FROM h GROUP BY 1), q AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT ts, CASE WHEN count(a) OVER w = 120 THEN stddev_samp(a) OVER w END AS sa, CASE WHEN count(b) OVER w = 120 THEN stddev_samp(b) OVER w END AS sb FROM q WINDOW w AS (ORDER BY ts ROWS 119 PRECEDING)),
z AS (SELECT ts, (sa - avg(sa) OVER ()) / stddev_samp(sa) OVER () + (sb - avg(sb) OVER ()) / stddev_samp(sb) OVER () AS score FROM s)
SELECT 0::BIGINT AS k, ts AS window_end, round(score, 6) AS score FROM z WHERE score IS NOT NULL ORDER BY z.score DESC, ts DESC LIMIT 1"""),
    "cyclical_features": (cyclical_features, "SELECT event_id, ts, round(sin(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_cos, round(sin(2 * pi() * month(ts) / 12), 6) + 0 AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) + 0 AS month_cos FROM events"),
    "sequence_windows": (sequence_windows, f"WITH {HOURLY}, w AS (SELECT event_type, ts, list(y) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l FROM h) SELECT event_type, ts, len(l) AS n, round(list_sum(l), 6) AS total, round(l[1], 6) AS oldest, round(l[24], 6) AS newest FROM w WHERE len(l) = 24"),
    "calibration_split": (calibration_split, f"WITH {HOURLY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) <= floor(count(*) OVER (PARTITION BY event_type) * 0.4) AS fit FROM h) SELECT event_type, fit, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(y), 6) AS mean_y FROM r GROUP BY 1, 2"),
    "dst_localize": (dst_localize, "SELECT file, line, u + CASE WHEN u < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS local, u AS ts FROM (SELECT o_orderkey // 96 AS file, o_orderkey % 96 AS line, TIMESTAMP '2024-10-27' + (o_orderkey % 96 * 15) * INTERVAL 1 MINUTE AS u FROM orders)"),
    "local_grid": (local_grid, "SELECT unnest(generate_series(TIMESTAMP '2024-03-29 23:00:00', TIMESTAMP '2024-03-31 22:00:00', INTERVAL 15 MINUTE)) AS ts"),
    "session_gaps": (session_gaps, "WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, s"),
    "tumbling_15m": (tumbling_15m, "SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01') AS ts, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY ALL"),
    "sliding_48h": (sliding_48h, "SELECT event_type, w AS ts, round(avg(value), 6) AS value, count(*) AS n FROM (SELECT event_type, value, unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS w FROM events) GROUP BY ALL"),
    "running_maximum": (running_maximum, f"WITH {HOURLY}, z AS (SELECT event_type, ts, CASE WHEN hour(ts) % 7 <> 0 THEN y END AS y FROM h) SELECT event_type, ts, round(y, 6) AS y, round(CASE WHEN y IS NOT NULL THEN max(y) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) END, 6) AS top FROM z"),
    "lag_covariance": (lag_covariance, f"WITH {HOURLY}, c AS (SELECT event_type, ts, y - avg(y) OVER (PARTITION BY event_type) AS c FROM h), r AS (SELECT event_type, c, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM c) SELECT a.event_type, k AS lag, round(avg(a.c * b.c), 6) AS gamma FROM range(6) t(k) JOIN r a ON true JOIN r b ON b.event_type = a.event_type AND b.rn = a.rn - k GROUP BY 1, 2"),
    "horizon_24h": (horizon_24h, f"WITH {HOURLY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM h WHERE ts >= TIMESTAMP '2024-01-15 11:00:00') SELECT event_type, ts, round(y, 6) AS y FROM r WHERE rn <= 24"),
    "hour_ceiling": (meter_ceil, "SELECT event_id, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS hour FROM events"),
}
