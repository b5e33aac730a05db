"""Affine and conformal calibration, transfer, and paired significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import calibrate, municipal, significance
from ..plans.calibrate import FLOORS
from .common import HOURLY, PAIR, hourly, rounded, t


def _base(spark, d):
    """Prices over quantities by (supplier mod 7): with a constant base in group 6 and a falling one in group 5."""
    g = F.col("l_suppkey") % 7
    q = F.when(g == 6, 10.0).when(g == 5, F.lit(50.0) - F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return t(spark, d, "lineitem").select(g.alias("site"), (F.col("l_extendedprice") / 1000).alias("y"), q.alias("base"))


BASE = "b AS (SELECT l_suppkey % 7 AS site, l_extendedprice / 1000 AS y, CASE l_suppkey % 7 WHEN 6 THEN 10 WHEN 5 THEN 50 - l_quantity ELSE l_quantity END AS base FROM lineitem), fit AS (SELECT site, count(*) AS n, avg(y - base) AS dd, regr_slope(y, base) AS a, regr_intercept(y, base) AS i, stddev_pop(base) AS s FROM b GROUP BY 1), cal AS (SELECT site, n, CASE WHEN n >= 2 AND s >= 1e-9 AND a > 0 THEN a ELSE 1 END AS scale, CASE WHEN n >= 2 AND s >= 1e-9 AND a > 0 THEN i ELSE dd END AS \"offset\" FROM fit)"


def affine_fit(spark, d):
    return rounded(calibrate.fit_affine(_base(spark, d), ["site"]))


def affine_apply(spark, d):
    b = _base(spark, d)
    p = b.join(F.broadcast(calibrate.fit_affine(b, ["site"])), "site").withColumn("p", calibrate.apply_affine(F.col("base") - 20))
    return rounded(p.groupBy("site").agg(F.avg("p").alias("mean_p"), F.min("p").alias("min_p"), F.count_if(F.col("p") == 0).alias("floored")))


def affine_transfer(spark, d):
    out = calibrate.transfer(_base(spark, d).withColumn("base", F.col("base") - 20))
    return rounded(out.withColumn("donor", F.coalesce(F.col("donor").cast("string"), F.lit("-"))), 5)


def pooled_scale(spark, d):
    c = calibrate.fit_affine(_base(spark, d), ["site"]).withColumn("technology", F.when(F.col("site") % 2 == 0, "wind").otherwise("solar"))
    return rounded(calibrate.pooled_scale(c, ["technology"]))


def _band(spark, d):
    lo = F.col("l_discount") * 100 + 10
    return t(spark, d, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("fold"), F.col("l_quantity").alias("y"), lo.alias("lo"), (lo + F.col("l_tax") * 200).alias("hi"))


_VALUES = ", ".join(f"({i}, {f}::DOUBLE)" for i, f in enumerate(FLOORS))


def _conformal_sql(keys: str) -> str:
    return f"""b AS (SELECT l_returnflag, year(l_shipdate) AS fold, l_quantity AS y, l_discount * 100 + 10 AS lo, l_discount * 100 + 10 + l_tax * 200 AS hi FROM lineitem),
m AS (SELECT {keys}, count(*) AS n, avg((hi - lo) / 2) AS mean FROM b GROUP BY ALL), fl(i, f) AS (VALUES {_VALUES}),
w AS (SELECT b.*, n, mean, i, f * mean AS wf, greatest((hi - lo) / 2, f * mean) AS w FROM b JOIN m USING ({keys}), fl WHERE n >= 2 AND mean > 0),
e AS (SELECT *, greatest(lo - y, y - hi) / w AS e FROM w WHERE w > 0),
q AS (SELECT {keys}, i, any_value(wf) AS wf, list_sort(list(e))[ceil(least(ceil((count(*) + 1) * 0.8) / count(*), 1) * (count(*) - 1))::INT + 1] AS q FROM e GROUP BY {keys}, i),
wd AS (SELECT {keys}, i, any_value(q.q) AS q, any_value(q.wf) AS wf, avg(hi + q.q * w - greatest(lo - q.q * w, 0)) AS width FROM e JOIN q USING ({keys}, i) GROUP BY {keys}, i),
best AS (SELECT {keys}, arg_min(q, (round(width, 6), i)) AS q, arg_min(wf, (round(width, 6), i)) AS wf, arg_min(width, (round(width, 6), i)) AS width FROM wd GROUP BY {keys})"""


def conformal_fit(spark, d):
    return rounded(calibrate.fit_conformal(_band(spark, d), ["l_returnflag"]).select("l_returnflag", "q", "w_floor", "width", "n"))


def conformal_sequential(spark, d):
    return rounded(calibrate.sequential_conformal(_band(spark, d), ["l_returnflag"]))


def _errors(spark, d):
    h = hourly(spark, d)
    a = h.filter("event_type = 'click'").select("ts", (F.col("y") - 50).alias("err_a"), F.col("y"))
    b = h.filter("event_type = 'view'").select("ts", (F.col("y") - 45).alias("err_b"))
    return a.join(b, "ts").withColumn("k", F.lit(0))


ERR = f"{HOURLY}, er AS (SELECT a.ts, a.y - 50 AS ea, a.y AS y, b.y - 45 AS eb FROM h a JOIN h b ON a.ts = b.ts WHERE a.event_type = 'click' AND b.event_type = 'view')"


def dm_statistic(spark, d):
    return rounded(significance.diebold_mariano(_errors(spark, d), ["k"], p_value=False))


def dm_test(spark, d):
    return rounded(significance.diebold_mariano(_errors(spark, d), ["k"]))


def pairwise_models(spark, d):
    h = hourly(spark, d).withColumn("err", F.col("y") - 50)
    return rounded(significance.model_pairs(h.withColumn("k", F.lit(0)), ["k"], model="event_type").groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n_hours"), F.avg(F.abs("err_a") - F.abs("err_b")).alias("gap")))


def sign_test(spark, d):
    m = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("technology"), F.year("l_shipdate").alias("fold")).agg(F.avg("l_tax").alias("nmae"))
    return rounded(significance.fold_summary(m, ["technology"], "A", "R"))


def block_bootstrap(spark, d):
    return rounded(significance.block_bootstrap(_errors(spark, d), ["k"], seed=3), 6)


def municipal_validation(spark, d):
    h = hourly(spark, d).select(F.col("event_type").alias("region"), "ts", "y", (F.lit(30.0) + F.hour("ts") % 7 * 4 + F.day("ts") * 0.5).alias("base"))
    return rounded(municipal.calibrate_and_score(h, ["region"])[1])


def municipal_intervals(spark, d):
    h = hourly(spark, d).select(F.col("event_type").alias("region"), "ts", "y", (F.lit(30.0) + F.hour("ts") % 7 * 4).alias("base")).withColumns({"lo": F.col("base") - 5, "hi": F.col("base") + 5})
    return rounded(municipal.interval_score(h, ["region"]))


QUERIES = {
    "municipal_validation": (municipal_validation, f"""WITH {HOURLY}, s AS (SELECT event_type AS region, y, 30 + hour(ts) % 7 * 4 + day(ts) * 0.5::DOUBLE AS base, lag(y, 24) OVER w AS back, row_number() OVER w <= floor(count(*) OVER (PARTITION BY event_type) * 0.4) AS fit FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
f AS (SELECT region, avg(y - base) AS dd, regr_slope(y, base) AS a, regr_intercept(y, base) AS i FROM s WHERE fit GROUP BY 1), c AS (SELECT region, CASE WHEN a > 0 THEN a ELSE 1 END AS a, CASE WHEN a > 0 THEN i ELSE dd END AS b FROM f),
x AS (SELECT s.region, y, base, back, greatest(a * base + b, 0) AS cal FROM s JOIN c USING (region) WHERE NOT fit),
u AS (SELECT region, 'raw' AS variant, y, base AS p FROM x UNION ALL SELECT region, 'calibrated', y, cal FROM x UNION ALL SELECT region, 'persistence', y, back FROM x)
SELECT region, variant, {PAIR} FROM u WHERE p IS NOT NULL GROUP BY 1, 2"""),
    "municipal_intervals": (municipal_intervals, f"""WITH {HOURLY}, s AS (SELECT event_type AS region, y, 30 + hour(ts) % 7 * 4::DOUBLE AS base, row_number() OVER (PARTITION BY event_type ORDER BY ts) <= floor(count(*) OVER (PARTITION BY event_type) * 0.4) AS fit FROM h),
f AS (SELECT region, avg(y - base) AS dd, regr_slope(y, base) AS a, regr_intercept(y, base) AS i FROM s WHERE fit GROUP BY 1), c AS (SELECT region, CASE WHEN a > 0 THEN a ELSE 1 END AS a, CASE WHEN a > 0 THEN i ELSE dd END AS b FROM f),
b AS (SELECT s.region, y, fit, greatest(a * (base - 5) + b, 0) AS lo, greatest(a * (base + 5) + b, 0) AS hi FROM s JOIN c USING (region)),
m AS (SELECT region, count(*) AS n, avg((hi - lo) / 2) AS mean FROM b WHERE fit GROUP BY 1), fl(i, f) AS (VALUES {_VALUES}),
e AS (SELECT b.*, i, f * mean AS wf, greatest((hi - lo) / 2, f * mean) AS w, greatest(lo - y, y - hi) / greatest((hi - lo) / 2, f * mean) AS e FROM b JOIN m USING (region), fl WHERE fit),
q AS (SELECT region, i, any_value(wf) AS wf, list_sort(list(e))[ceil(least(ceil((count(*) + 1) * 0.8) / count(*), 1) * (count(*) - 1))::INT + 1] AS q FROM e GROUP BY 1, 2),
wd AS (SELECT region, i, any_value(q.q) AS q, any_value(q.wf) AS wf, avg(hi + q.q * w - greatest(lo - q.q * w, 0)) AS width FROM e JOIN q USING (region, i) GROUP BY 1, 2),
best AS (SELECT region, arg_min(q, (round(width, 6), i)) AS q, arg_min(wf, (round(width, 6), i)) AS wf FROM wd GROUP BY 1),
r AS (SELECT b.*, greatest(lo - q * greatest((hi - lo) / 2, wf), 0) AS l2, hi + q * greatest((hi - lo) / 2, wf) AS h2 FROM b JOIN best USING (region) WHERE NOT fit)
SELECT region, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS picp_before, round(avg(hi - lo) / avg(abs(y)), 6) AS mpiw_before, round(avg(CASE WHEN y BETWEEN l2 AND h2 THEN 1 ELSE 0 END), 6) AS picp_after, round(avg(h2 - l2) / avg(abs(y)), 6) AS mpiw_after FROM r GROUP BY 1"""),
    "affine_fit": (affine_fit, f"WITH {BASE} SELECT site, round(scale, 6)::DOUBLE AS scale, round(\"offset\", 6) AS \"offset\", n FROM cal"),
    "affine_apply": (affine_apply, f"WITH {BASE}, p AS (SELECT site, greatest(scale * (base - 20) + \"offset\", 0) AS p FROM b JOIN cal USING (site)) SELECT site, round(avg(p), 6) AS mean_p, round(min(p), 6) AS min_p, count(*) FILTER (p = 0) AS floored FROM p GROUP BY 1"),
    "affine_transfer": (affine_transfer, f"""WITH {BASE.replace("CASE l_suppkey % 7 WHEN 6 THEN 10 WHEN 5 THEN 50 - l_quantity ELSE l_quantity END", "CASE l_suppkey % 7 WHEN 6 THEN 10 WHEN 5 THEN 50 - l_quantity ELSE l_quantity END - 20")},
v AS (SELECT a.site, c.site AS donor, CASE WHEN a.site = c.site THEN 'oracle' ELSE 'transferred' END AS variant, c.scale, c."offset" FROM cal a, cal c UNION ALL SELECT site, NULL, 'uncalibrated', 1, 0 FROM cal),
p AS (SELECT v.*, y, greatest(scale * base + "offset", 0) AS p, CASE WHEN scale * base + "offset" < 0 THEN 1 ELSE 0 END AS neg FROM b JOIN v USING (site))
SELECT site, coalesce(donor::VARCHAR, '-') AS donor, variant, {PAIR.replace(', 6)', ', 5)')}, round(avg(neg), 5) AS clipped FROM p GROUP BY 1, 2, 3"""),
    "pooled_scale": (pooled_scale, f"WITH {BASE} SELECT CASE WHEN site % 2 = 0 THEN 'wind' ELSE 'solar' END AS technology, round(avg(scale), 6) AS scale, 0::DOUBLE AS \"offset\" FROM cal GROUP BY 1"),
    "conformal_fit": (conformal_fit, f"WITH {_conformal_sql('l_returnflag')} SELECT l_returnflag, round(q, 6) AS q, round(wf, 6) AS w_floor, round(width, 6) AS width, n FROM best JOIN m USING (l_returnflag)"),
    "conformal_sequential": (conformal_sequential, f"""WITH {_conformal_sql('l_returnflag, fold')}, nx AS (SELECT *, lead(fold) OVER (PARTITION BY l_returnflag ORDER BY fold) AS nf FROM best),
r AS (SELECT b.l_returnflag, b.fold, nx.fold AS cal_fold, y, lo, hi, greatest(lo - q * greatest((hi - lo) / 2, wf), 0) AS l2, hi + q * greatest((hi - lo) / 2, wf) AS h2 FROM b JOIN nx ON nx.l_returnflag = b.l_returnflag AND nx.nf = b.fold)
SELECT l_returnflag, fold, cal_fold, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS picp_before, round(avg(CASE WHEN y BETWEEN l2 AND h2 THEN 1 ELSE 0 END), 6) AS picp_after, round(avg(hi - lo) / avg(abs(y)), 6) AS mpiw_before, round(avg(h2 - l2) / avg(abs(y)), 6) AS mpiw_after FROM r GROUP BY 1, 2, 3"""),
    "dm_statistic": (dm_statistic, f"""WITH {ERR}, d AS (SELECT abs(ea) - abs(eb) AS d, row_number() OVER (ORDER BY ts) AS rn FROM er), s AS (SELECT count(*) AS n, avg(d) AS m FROM d),
g AS (SELECT k, avg((a.d - m) * (b.d - m)) AS g FROM s, range(200) r(k) JOIN d a ON true JOIN d b ON b.rn = a.rn - k WHERE k <= floor(pow(n, 1.0 / 3) + 1e-9) GROUP BY 1)
SELECT 0::BIGINT AS k, n, round(m / sqrt((SELECT sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (floor(pow(n, 1.0 / 3) + 1e-9) + 1)) * g END) FROM g) / n), 6) AS stat FROM s"""),
    "dm_test": (dm_test, None),
    "pairwise_models": (pairwise_models, f"WITH {HOURLY} SELECT a.event_type AS model_a, b.event_type AS model_b, count(*) AS n_hours, round(avg(abs(a.y - 50) - abs(b.y - 50)), 6) AS gap FROM h a JOIN h b ON a.ts = b.ts AND a.event_type < b.event_type GROUP BY 1, 2"),
    "sign_test": (sign_test, """WITH m AS (SELECT l_linestatus AS technology, year(l_shipdate) AS fold, avg(l_tax) FILTER (l_returnflag = 'A') - avg(l_tax) FILTER (l_returnflag = 'R') AS gap FROM lineitem GROUP BY 1, 2),
s AS (SELECT technology, avg(gap) AS a, min(gap) AS b, max(gap) AS c, count(*) FILTER (gap < 0) AS wins, count(*) FILTER (gap <> 0) AS decided FROM m WHERE gap IS NOT NULL GROUP BY 1),
c AS (SELECT technology, k, factorial(decided::INT) / (factorial(k::INT) * factorial((decided - k)::INT)) * pow(0.5, decided) AS p FROM s, range(0, 100) r(k) WHERE k <= decided)
SELECT technology, round(a, 6) AS gap_mean, round(b, 6) AS gap_min, round(c, 6) AS gap_max, wins, decided, round((SELECT least(1, sum(x.p)) FROM c x WHERE x.technology = s.technology AND x.p <= (SELECT y.p FROM c y WHERE y.technology = s.technology AND y.k = s.wins) * (1 + 1e-7)), 6) AS sign_p FROM s"""),
    "block_bootstrap": (block_bootstrap, None),
}
