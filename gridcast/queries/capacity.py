"""Folds, trailing capacity and the capacity-factor matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries
from ..plans import baselines, folds, matrix
from .common import DAILY, PAIR, daily_orders, rounded, t


def _orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), "o_totalprice")


def purged_folds(spark, d):
    return rounded(folds.fold_bounds(_orders(spark, d)))


def fold_summary(spark, d):
    o = _orders(spark, d)
    return rounded(folds.summary(folds.assign(o, folds.fold_bounds(o))))


def fold_gap_check(spark, d):
    o = _orders(spark, d)
    s = folds.summary(folds.assign(o, folds.fold_bounds(o)))
    wide = s.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("last_ts"))).alias("a"), F.max(F.when(F.col("role") == "test", F.col("first_ts"))).alias("b"))
    return rounded(wide.select("fold", F.date_diff("b", "a").cast("bigint").alias("gap_days"), (F.date_diff("b", "a") >= 3).alias("purged")))


def trailing_capacity(spark, d):
    q = timeseries.trailing_quantile(daily_orders(spark, d), ["k"], "d", "y", 365, 0.999, 30, "q")
    return rounded(q.select("d", "y", "q"), 4)


def effective_capacity(spark, d):
    q = timeseries.effective_capacity(daily_orders(spark, d), ["k"], "d", "y", 365, 0.999, 30)
    return rounded(q.select("d", "y", "cap"), 4)


def capacity_by_year(spark, d):
    q = timeseries.effective_capacity(daily_orders(spark, d), ["k"], "d", "y", 365, 0.999, 30)
    return rounded(matrix.capacity_by_year(q, ["k"], "d", "cap"), 4)


def capacity_audit(spark, d):
    q = timeseries.effective_capacity(daily_orders(spark, d), ["k"], "d", "y", 365, 0.999, 30).filter("cap IS NOT NULL")
    return rounded(matrix.capacity_audit(q, ["k"], "d", "y", "cap"), 4)


def capacity_factor_matrix(spark, d):
    target = daily_orders(spark, d).select(F.col("d").alias("ts"), (F.col("y") / 1000).alias("wind_mw"), (F.col("y") / 2000).alias("solar_mw"))
    day = t(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("ts"))
    priors = {"wind": day.agg(F.sum("l_quantity").alias("prior_mw")), "solar": day.agg(F.sum("l_discount").alias("prior_mw"))}
    weather = day.agg(F.avg("l_tax").alias("temperature_2m"), F.avg("l_quantity").alias("surface_pressure"), F.avg("l_discount").alias("relative_humidity_2m"))
    return rounded(matrix.feature_matrix(target, priors, weather, {"wind": 2000.0, "solar": 3.0}, least=30), 4)


def fold_baselines(spark, d):
    day = daily_orders(spark, d)
    b = folds.fold_bounds(day, "d", n=3)
    return rounded(baselines.baseline_metrics(day.withColumn("y", F.col("y") / 1000), b, ["k"], "d", "y", {"dow": F.weekday("d"), "month": F.month("d")}, "1 DAY"), 4)


_CAP = f"""{DAILY}, q AS (SELECT d, y, quantile_cont(y, 0.999) OVER w AS c, count(y) OVER w AS n FROM daily WINDOW w AS (ORDER BY d RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW)),
z AS (SELECT d, y, lag(CASE WHEN n >= 30 THEN c END, 1) OVER (ORDER BY d) AS c1 FROM q), cap AS (SELECT d, y, CASE WHEN c1 IS NOT NULL THEN max(c1) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) END AS cap FROM z)"""
_FOLDS = "f AS (SELECT i + 1 AS fold, t0, t1 - to_days((3 - i) * 365) AS te, t1 - to_days((4 - i) * 365) AS ts FROM (SELECT min(o_orderdate) AS t0, max(o_orderdate) AS t1 FROM orders), range(4) r(i))"
_ROLES = f"{_FOLDS}, a AS (SELECT fold, 'train' AS role, o_orderdate AS d FROM f JOIN orders ON o_orderdate <= f.ts - INTERVAL 3 DAY UNION ALL SELECT fold, 'test', o_orderdate FROM f JOIN orders ON o_orderdate > f.ts AND o_orderdate <= te)"
_MATRIX = f"""WITH {_CAP.replace('daily AS (SELECT o_orderdate AS d, sum(o_totalprice) AS y FROM orders GROUP BY 1)', '''li AS (SELECT l_shipdate AS d, sum(l_quantity) AS wp, sum(l_discount) AS sp, avg(l_tax) AS t, avg(l_quantity) AS pr, avg(l_discount) AS rh FROM lineitem GROUP BY 1),
daily AS (SELECT d, sum(o_totalprice) AS y FROM (SELECT o_orderdate AS d, o_totalprice FROM orders) JOIN (SELECT d FROM li) USING (d) GROUP BY 1)''')}
SELECT d AS ts, round(y / 1000, 4) AS wind_mw, round(y / 2000, 4) AS solar_mw, round(wp, 4) AS wind_prior_mw, round(sp, 4) AS solar_prior_mw, round(t, 4) AS temperature_2m, round(pr, 4) AS surface_pressure, round(rh, 4) AS relative_humidity_2m,
round(sin(2 * pi() * hour(d) / 24), 4) AS hour_sin, round(cos(2 * pi() * hour(d) / 24), 4) AS hour_cos, round(sin(2 * pi() * month(d) / 12), 4) + 0 AS month_sin, round(cos(2 * pi() * month(d) / 12), 4) + 0 AS month_cos,
round(least(wp / 2000, 1.5), 4) AS wind_prior_cf, round(cap / 1000, 4) AS wind_cap_mw, round(least(greatest(y / cap, 0), 1.5), 4) AS wind_cf, round(least(sp / 3, 1.5), 4) AS solar_prior_cf, round(cap / 2000, 4) AS solar_cap_mw, round(least(greatest(y / cap, 0), 1.5), 4) AS solar_cf
FROM cap JOIN li USING (d) WHERE cap IS NOT NULL"""

_PAIR4 = PAIR.replace(", 6)", ", 4)")

QUERIES = {
    "fold_baselines": (fold_baselines, f"""WITH daily AS (SELECT o_orderdate AS d, sum(o_totalprice) / 1000 AS y FROM orders GROUP BY 1),
f AS (SELECT i + 1 AS fold, t1 - to_days((2 - i) * 365) AS te, t1 - to_days((3 - i) * 365) AS ts FROM (SELECT max(d) AS t1 FROM daily), range(3) r(i)),
te AS (SELECT fold, d, y FROM f JOIN daily ON d > f.ts AND d <= te), tr AS (SELECT fold, isodow(d) AS w, month(d) AS m, avg(y) AS p FROM f JOIN daily ON d <= f.ts - INTERVAL 3 DAY GROUP BY ALL),
u AS (SELECT 'persistence' AS model, fold, te.y, b.y AS p FROM te JOIN daily b ON b.d = te.d - INTERVAL 1 DAY UNION ALL SELECT 'climatology', te.fold, te.y, tr.p FROM te JOIN tr ON tr.fold = te.fold AND w = isodow(te.d) AND m = month(te.d))
SELECT model, 0::BIGINT AS k, fold, {_PAIR4} FROM u GROUP BY 1, 3"""),
    "purged_folds": (purged_folds, f"WITH {_FOLDS} SELECT fold, t0 AS train_start, ts - INTERVAL 3 DAY AS train_end, ts AS test_start, te AS test_end FROM f"),
    "fold_summary": (fold_summary, f"WITH {_ROLES} SELECT fold, role, min(d) AS first_ts, max(d) AS last_ts, count(*) AS n FROM a GROUP BY 1, 2"),
    "fold_gap_check": (fold_gap_check, f"WITH {_ROLES}, w AS (SELECT fold, max(d) FILTER (role = 'train') AS a, min(d) FILTER (role = 'test') AS b FROM a GROUP BY 1) SELECT fold, date_diff('day', a, b) AS gap_days, date_diff('day', a, b) >= 3 AS purged FROM w"),
    "trailing_capacity": (trailing_capacity, f"WITH {_CAP} SELECT d, round(y, 4) AS y, round(CASE WHEN n >= 30 THEN c END, 4) AS q FROM q"),
    "effective_capacity": (effective_capacity, f"WITH {_CAP} SELECT d, round(y, 4) AS y, round(cap, 4) AS cap FROM cap"),
    "capacity_by_year": (capacity_by_year, f"WITH {_CAP} SELECT 0::BIGINT AS k, year(d) AS year, round(arg_max(cap, d), 4) AS cap FROM cap WHERE cap IS NOT NULL GROUP BY 2"),
    "capacity_audit": (capacity_audit, f"WITH {_CAP} SELECT 0::BIGINT AS k, year(d) AS year, round(max(y), 4) AS peak, round(quantile_cont(y, 0.999), 4) AS p999, count(y) AS n, round(avg(CASE WHEN y > cap THEN 1 ELSE 0 END) * 100, 4) AS over_pct FROM cap WHERE cap IS NOT NULL GROUP BY 2"),
    "capacity_factor_matrix": (capacity_factor_matrix, _MATRIX),
}
