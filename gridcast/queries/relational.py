"""Joins, aggregates, reshaping, set operations, ordering and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import as_double, decimal_comma, grouped_decimal_comma, hour_floor, zero_fill_code
from ..operators import clean, spatial
from ..plans import metrics
from ..sources import readers
from .common import HOURLY, hourly, rounded, t
from .series import TYPES


def union_nodes(spark, d):
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    return c.select(F.col("c_nationkey").cast("bigint").alias("node")).union(s.select(F.col("s_nationkey").cast("bigint"))).distinct()


def intersect_hours(spark, d):
    ev = t(spark, d, "events").select(hour_floor("ts").alias("ts"), "event_type")
    return ev.filter("event_type = 'click'").select("ts").intersect(ev.filter("event_type = 'view'").select("ts"))


def subtract_keys(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("key")).subtract(t(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey"))


def union_missing_cols(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return a.unionByName(t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal"), allowMissingColumns=True)


def semi_join(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def anti_join(spark, d):
    return t(spark, d, "part").join(t(spark, d, "lineitem").filter("l_discount >= 0.05 AND l_quantity > 40"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


def densify(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "customer").select("c_mktsegment").distinct()
    have = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("n_nationkey").crossJoin(F.broadcast(r))  # two registries of fixed size
    return rounded(grid.join(have, ["n_nationkey", "c_mktsegment"], "left").withColumn("n", F.coalesce("n", F.lit(0))))


def donor_pairs(spark, d):
    r = t(spark, d, "region").select("r_name")
    return r.select(F.col("r_name").alias("donor")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("target")))).filter("donor <> target")


def code_lookup(spark, d):
    code = F.concat(F.lit("6"), (F.col("c_custkey") % 20 + 90).cast("string"))
    return rounded(t(spark, d, "customer").select("c_custkey", clean.orientation(code).alias("azimuth"), clean.tilt(F.concat(F.lit("8"), F.lpad((F.col("c_custkey") % 12).cast("string"), 2, "0"))).alias("tilt"), clean.manufacturer((F.col("c_custkey") % 5 + 1584).cast("string")).alias("maker"), clean.flag(F.when(F.col("c_custkey") % 3 == 0, "852").when(F.col("c_custkey") % 3 == 1, "853"), "852").alias("ground")))


def decimal_comma_clean(spark, d):
    c = t(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 11 == 0, "n.v.").when(F.col("c_custkey") % 11 == 1, "-").when(F.col("c_custkey") % 11 == 2, "").when(F.col("c_custkey") % 11 == 3, "1.234,5").otherwise(F.concat(F.lit(" "), F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(","))))
    return rounded(c.select("c_custkey", decimal_comma(text).alias("plain"), grouped_decimal_comma(text).alias("grouped")))


def safe_casts(spark, d):
    p = t(spark, d, "part")
    text = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, "x1").when(F.col("p_partkey") % 5 == 2, "NaN").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
    return rounded(p.select("p_partkey", as_double(text).alias("v"), zero_fill_code(F.col("p_size").cast("string")).alias("code"), zero_fill_code(F.lit("1234567")).alias("long")))


def weather_json_explode(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.format_string('{"hourly":{"time":["2024-01-01T00:00","2024-01-01T01:00"],"temperature_2m":[%d.5,null],"wind_speed_10m":[%d,2.25]}}', F.col("n_nationkey"), F.col("n_regionkey")).alias("j"))
    return rounded(readers.explode_hourly(n, "j", ["n_nationkey"], ["temperature_2m", "wind_speed_10m"]))


def meter_json_flatten(spark, d):
    ev = t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    total = F.when(F.col("event_id") % 4 == 0, F.lit(0.0)).otherwise(k * 10)
    item = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("usage"))
    js = F.to_json(F.struct(F.struct(F.when(F.col("event_id") % 6 == 0, 0).otherwise(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("end")).alias("timestamp"), F.struct(total.alias("total"), F.array(item("solar", k), item("wind", k * 2)).alias("list")).alias("feedIn"), F.struct(F.array(item("industry", k + 1)).alias("list")).alias("consumptions"), k.alias("autarky"), (k * 500).alias("dailyCo2Savings")))
    flat = readers.flatten_meter(ev.select("event_id", js.alias("j")), "j", ["event_id"], F.timestamp_seconds(F.lit(1700000000)))
    return rounded(flat.select("event_id", F.unix_seconds("ts").alias("sec"), "solar", "wind", "biomass", "industry", "public", "regional_total", "solar_share", "co2_tons"))


def oof_pivot(spark, d):
    return rounded(hourly(spark, d).groupBy("ts").pivot("event_type", TYPES).agg(F.avg("y")))


def melt_columns(spark, d):
    o = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("wind"), F.sum("l_discount").alias("solar"))
    return rounded(o.unpivot("l_returnflag", ["wind", "solar"], "technology", "mw"))


def ablation_summary(spark, d):
    li = t(spark, d, "lineitem")
    name = F.concat(F.lower("l_linestatus"), F.lit("_"), F.when(F.col("l_returnflag") == "A", "full").when(F.col("l_returnflag") == "N", "no_prior").otherwise("prior_only"))
    base, variant = clean.split_model_name("model")
    m = li.groupBy(name.alias("model")).agg(F.avg("l_discount").alias("nmae")).select(base.alias("base"), variant.alias("variant"), "nmae")
    wide = m.groupBy("base").pivot("variant", ["full", "no_prior", "prior_only"]).agg(F.first("nmae"))
    return rounded(wide.withColumn("penalty_pct", F.try_divide(F.col("no_prior") - F.col("full"), F.col("full")) * 100))


def best_model_skill(spark, d):
    m = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("model")).agg((F.avg("o_totalprice") / 1000).alias("nmae"))
    s = metrics.skill(m, ["yr"], "model", "5-LOW")
    return rounded(clean.keep_first(s, ["yr"], "nmae", "model"))


def skill_scores(spark, d):
    m = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("model")).agg((F.avg("o_totalprice") / 1000).alias("nmae"))
    return rounded(metrics.skill(m, ["st"], "model", "5-LOW"))


def scale_gap_join(spark, d):
    li = t(spark, d, "lineitem")
    key = ["l_returnflag", "l_linestatus"]
    a = li.filter("l_quantity > 25").groupBy(*key).agg(F.avg("l_discount").alias("macro"))
    b = li.filter("l_quantity <= 25").groupBy(*key).agg(F.avg("l_discount").alias("micro"))
    return rounded(a.join(b, key).withColumn("gap", F.col("micro") - F.col("macro")))


def correlation_matrix(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(cols) for b in cols[i:]])
    li = t(spark, d, "lineitem").select(F.explode(pairs).alias("p")).select("p.*")
    return rounded(li.groupBy("a", "b").agg(metrics.safe_corr("x", "y").alias("r")))


def slope_stability(spark, d):
    li = t(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("yr")).agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"))
    return rounded(li.groupBy("l_returnflag").agg(F.avg("slope").alias("mean"), F.try_divide(F.stddev_samp("slope"), F.avg("slope")).alias("cv"), F.countDistinct("yr").alias("years"), F.min_by("slope", "yr").alias("first_slope")))


def coverage_error(spark, d):
    li = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg((F.col("l_quantity").between(5, 45)).cast("int")).alias("picp"))
    return rounded(li.agg(F.avg(F.abs(F.col("picp") - 0.8)).alias("mean_abs_error"), F.count(F.lit(1)).alias("n")))


def cv_summary(spark, d):
    m = t(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("fold")).agg(F.avg("l_tax").alias("nmae"), F.avg("l_discount").alias("picp"))
    return rounded(m.groupBy("l_returnflag").agg(F.avg("nmae").alias("nmae"), F.avg("picp").alias("picp"), F.count(F.lit(1)).alias("folds")))


def global_share(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("x"))
    whole = n.agg(F.sum("x").alias("total"))
    return rounded(n.crossJoin(F.broadcast(whole)).select("l_returnflag", "l_linestatus", F.try_divide("x", "total").alias("share")))


def density_grid(spark, d):
    li = t(spark, d, "lineitem")
    return rounded(li.groupBy(F.width_bucket("l_quantity", F.lit(1.0), F.lit(51.0), F.lit(10)).alias("bx"), F.width_bucket("l_extendedprice", F.lit(0.0), F.lit(100000.0), F.lit(10)).alias("by")).agg(F.count(F.lit(1)).alias("n"), F.log10(F.count(F.lit(1)).cast("double")).alias("log_n")))


def interaction_matrix(spark, d):
    p = t(spark, d, "part").groupBy(F.concat_ws(" & ", "p_type", F.element_at(F.split("p_name", " "), 1)).alias("term")).agg(F.avg("p_retailprice").alias("w"))
    a, b = F.split("term", " & ")[0], F.split("term", " & ")[1]
    x = p.select(a.alias("f"), b.alias("g"), "w")
    return rounded(x.unionByName(x.select(F.col("g").alias("f"), F.col("f").alias("g"), "w")))


def calibration_map(spark, d):
    m = t(spark, d, "nation").select("n_name", F.create_map(F.concat(F.lit("lgb_"), F.lit("wind")), F.col("n_nationkey") * 1.5, F.lit("ebm_solar"), F.col("n_regionkey") * 2.0).alias("m"))
    e = m.select("n_name", F.explode("m").alias("key", "scale"))
    return rounded(e.select("n_name", F.regexp_extract("key", "^(.*)_([^_]+)$", 1).alias("model"), F.regexp_extract("key", "^(.*)_([^_]+)$", 2).alias("technology"), "scale"))


def time_slice(spark, d):
    lo, hi = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-06 12:00:00").cast("timestamp_ntz")
    return t(spark, d, "events").filter(F.col("ts").between(lo, hi)).select("event_id", "ts", "value")


def not_in_either(spark, d):
    return t(spark, d, "orders").filter(~(F.col("o_orderstatus").isin("P") | F.col("o_orderpriority").isin("5-LOW", "1-URGENT"))).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def nulls_last_rank(spark, d):
    v = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal"))
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", v.alias("v"))
    w = Window.partitionBy("s_nationkey").orderBy(F.asc_nulls_last("v"), "s_suppkey")
    return rounded(s.withColumn("rk", F.row_number().over(w)))


def top_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").withColumn("rk", F.row_number().over(w)).filter("rk = 1").select("o_custkey", "o_orderkey", "o_totalprice")


def category_order(spark, d):
    order = ["1-URGENT", "3-MEDIUM", "5-LOW", "2-HIGH"]
    m = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    pos = F.array_position(F.lit(order), F.col("o_orderpriority"))
    return rounded(m.withColumn("pos", F.when(pos > 0, pos).otherwise(len(order) + 1)))


def node_batches(spark, d):
    c = t(spark, d, "customer").select((F.col("c_custkey") % 230).alias("lat"), (F.col("c_custkey") * 7 % 340).alias("lon")).distinct()
    return rounded(spatial.batches(c, ["lat", "lon"], 5))


def drop_incomplete(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("b"))
    return o.dropna(how="any").select("o_orderkey", F.lit("any").alias("rule")).union(clean.drop_all_null(o, ["a", "b"]).select("o_orderkey", F.lit("all").alias("rule")))


def distinct_counts(spark, d):
    return rounded(t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts"), F.count(F.lit(1)).alias("n")))


def clipped_fraction(spark, d):
    raw = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity") * 2 - 30)
    return rounded(t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg(F.coalesce(raw < 0, F.lit(False)).cast("int")).alias("clipped")))


def random_sample(spark, d):
    u = F.substring(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42")).cast("binary")), 1, 15)
    return t(spark, d, "orders").orderBy(u, "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def state_split(spark, d):
    yes, no = clean.split_by(t(spark, d, "orders"), F.col("o_orderstatus") == "F")
    return rounded(yes.groupBy(F.lit("yes").alias("part")).agg(F.count(F.lit(1)).alias("n")).union(no.groupBy(F.lit("no").alias("part")).agg(F.count(F.lit(1)).alias("n"))))


QUERIES = {
    "random_sample": (random_sample, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY substr(md5(o_orderkey || ':42'), 1, 15), o_orderkey LIMIT 100"),
    "state_split": (state_split, "SELECT CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS part, count(*) AS n FROM orders GROUP BY 1"),
    "union_nodes": (union_nodes, "SELECT c_nationkey::BIGINT AS node FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier"),
    "intersect_hours": (intersect_hours, "SELECT date_trunc('hour', ts) AS ts FROM events WHERE event_type = 'click' INTERSECT SELECT date_trunc('hour', ts) FROM events WHERE event_type = 'view'"),
    "subtract_keys": (subtract_keys, "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000"),
    "union_missing_cols": (union_missing_cols, "SELECT c_custkey AS key, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier"),
    "semi_join": (semi_join, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "anti_join": (anti_join, "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.05 AND l_quantity > 40)"),
    "densify": (densify, "SELECT n_nationkey::BIGINT AS n_nationkey, s.c_mktsegment, count(c_custkey) AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN customer c ON c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment GROUP BY 1, 2"),
    "donor_pairs": (donor_pairs, "SELECT a.r_name AS donor, b.r_name AS target FROM region a, region b WHERE a.r_name <> b.r_name"),
    "code_lookup": (code_lookup, "SELECT c_custkey, CASE WHEN c_custkey % 20 BETWEEN 5 AND 9 THEN (c_custkey % 20 - 5) * 45.0::DOUBLE END AS azimuth, CASE c_custkey % 12 WHEN 6 THEN 90.0 WHEN 7 THEN 75.0 WHEN 8 THEN 50.5 WHEN 9 THEN 30.5 WHEN 10 THEN 12.5 END::DOUBLE AS tilt, CASE c_custkey % 5 WHEN 0 THEN 'Siemens' WHEN 2 THEN 'Enercon' WHEN 3 THEN 'Enercon' ELSE '' END AS maker, c_custkey % 3 = 0 AS ground FROM customer"),
    "decimal_comma_clean": (decimal_comma_clean, "SELECT c_custkey, CASE WHEN c_custkey % 11 > 3 THEN round(c_acctbal, 2) END AS plain, CASE WHEN c_custkey % 11 = 3 THEN 1234.5::DOUBLE WHEN c_custkey % 11 > 3 THEN round(c_acctbal, 2) END AS grouped FROM customer"),
    "safe_casts": (safe_casts, "SELECT p_partkey, CASE WHEN p_partkey % 5 > 2 THEN p_size::DOUBLE END AS v, lpad(p_size::VARCHAR, 5, '0') AS code, '1234567' AS long FROM part"),
    "weather_json_explode": (weather_json_explode, "SELECT n_nationkey::BIGINT AS n_nationkey, ts, CASE WHEN h = 0 THEN n_nationkey + 0.5::DOUBLE END AS temperature_2m, CASE WHEN h = 0 THEN n_regionkey::DOUBLE ELSE 2.25::DOUBLE END AS wind_speed_10m FROM nation, (VALUES (0, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 01:00:00')) v(h, ts)"),
    "meter_json_flatten": (meter_json_flatten, """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 1700000000 ELSE epoch(date_trunc('second', ts))::BIGINT END AS sec, k AS solar, k * 2 AS wind, 0.0::DOUBLE AS biomass, k + 1 AS industry, 0.0::DOUBLE AS public, tot AS regional_total,
round(coalesce(k / nullif(tot, 0), 0) * 100, 6) AS solar_share, round(k / 2, 6) AS co2_tons FROM (SELECT *, CASE WHEN event_id % 4 = 0 OR k = 0 THEN k * 3 ELSE k * 10 END AS tot FROM (SELECT event_id, ts, json_extract_string(props, '$.k')::DOUBLE AS k FROM events))"""),
    "oof_pivot": (oof_pivot, f"WITH {HOURLY} SELECT ts, " + ", ".join(f"round(avg(y) FILTER (event_type = '{x}'), 6) AS {x}" for x in TYPES) + " FROM h GROUP BY 1"),
    "melt_columns": (melt_columns, "SELECT l_returnflag, 'wind' AS technology, round(sum(l_quantity), 6) AS mw FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'solar', round(sum(l_discount), 6) FROM lineitem GROUP BY 1"),
    "ablation_summary": (ablation_summary, "WITH m AS (SELECT lower(l_linestatus) AS base, l_returnflag AS v, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2), w AS (SELECT base, max(x) FILTER (v = 'A') AS f, max(x) FILTER (v = 'N') AS n, max(x) FILTER (v NOT IN ('A', 'N')) AS p FROM m GROUP BY 1) SELECT base, round(f, 6) AS \"full\", round(n, 6) AS no_prior, round(p, 6) AS prior_only, round((n - f) / f * 100, 6) AS penalty_pct FROM w"),
    "best_model_skill": (best_model_skill, "WITH m AS (SELECT year(o_orderdate) AS yr, o_orderpriority AS model, avg(o_totalprice) / 1000 AS nmae FROM orders GROUP BY 1, 2), s AS (SELECT m.yr, m.model, m.nmae, 1 - m.nmae / b.nmae AS skill FROM m LEFT JOIN m b ON b.yr = m.yr AND b.model = '5-LOW' WHERE m.model <> '5-LOW') SELECT yr, model, round(nmae, 6) AS nmae, round(skill, 6) AS skill FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY nmae, model) AS rn FROM s) WHERE rn = 1"),
    "skill_scores": (skill_scores, "WITH m AS (SELECT o_orderstatus AS st, o_orderpriority AS model, avg(o_totalprice) / 1000 AS nmae FROM orders GROUP BY 1, 2) SELECT m.st, m.model, round(m.nmae, 6) AS nmae, round(1 - m.nmae / b.nmae, 6) AS skill FROM m LEFT JOIN m b ON b.st = m.st AND b.model = '5-LOW' WHERE m.model <> '5-LOW'"),
    "scale_gap_join": (scale_gap_join, "SELECT l_returnflag, l_linestatus, round(a, 6) AS macro, round(b, 6) AS micro, round(b - a, 6) AS gap FROM (SELECT l_returnflag, l_linestatus, avg(l_discount) FILTER (l_quantity > 25) AS a, avg(l_discount) FILTER (l_quantity <= 25) AS b FROM lineitem GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL"),
    "correlation_matrix": (correlation_matrix, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) AS r FROM lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i:])),
    "slope_stability": (slope_stability, "WITH s AS (SELECT l_returnflag, year(l_shipdate) AS yr, regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(avg(slope), 6) AS mean, round(stddev_samp(slope) / avg(slope), 6) AS cv, count(DISTINCT yr) AS years, round(min_by(slope, yr), 6) AS first_slope FROM s GROUP BY 1"),
    "coverage_error": (coverage_error, "SELECT round(avg(abs(picp - 0.8)), 6) AS mean_abs_error, count(*) AS n FROM (SELECT avg(CASE WHEN l_quantity BETWEEN 5 AND 45 THEN 1 ELSE 0 END) AS picp FROM lineitem GROUP BY l_returnflag, l_linestatus)"),
    "cv_summary": (cv_summary, "SELECT l_returnflag, round(avg(a), 6) AS nmae, round(avg(b), 6) AS picp, count(*) AS folds FROM (SELECT l_returnflag, year(l_shipdate) AS f, avg(l_tax) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1"),
    "global_share": (global_share, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1, 2"),
    "density_grid": (density_grid, "SELECT (floor((l_quantity - 1) / 5) + 1)::BIGINT AS bx, least(floor(l_extendedprice / 10000) + 1, 11)::BIGINT AS by, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM lineitem GROUP BY 1, 2"),
    "interaction_matrix": (interaction_matrix, "WITH p AS (SELECT p_type AS f, split_part(p_name, ' ', 1) AS g, round(avg(p_retailprice), 6) AS w FROM part GROUP BY 1, 2) SELECT f, g, w FROM p UNION ALL SELECT g, f, w FROM p"),
    "calibration_map": (calibration_map, "SELECT n_name, 'lgb' AS model, 'wind' AS technology, round(n_nationkey * 1.5, 6)::DOUBLE AS scale FROM nation UNION ALL SELECT n_name, 'ebm', 'solar', (n_regionkey * 2.0)::DOUBLE FROM nation"),
    "time_slice": (time_slice, "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'"),
    "not_in_either": (not_in_either, "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE NOT (o_orderstatus = 'P' OR o_orderpriority IN ('5-LOW', '1-URGENT'))"),
    "nulls_last_rank": (nulls_last_rank, "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, v, row_number() OVER (PARTITION BY s_nationkey ORDER BY v ASC NULLS LAST, s_suppkey) AS rk FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS v FROM supplier)"),
    "top_per_group": (top_per_group, "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk = 1"),
    "category_order": (category_order, "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END::BIGINT AS pos FROM orders GROUP BY 1"),
    "node_batches": (node_batches, "SELECT lat, lon, floor((row_number() OVER (ORDER BY lat, lon) - 1) / 5)::BIGINT AS batch FROM (SELECT DISTINCT c_custkey % 230 AS lat, c_custkey * 7 % 340 AS lon FROM customer)"),
    "drop_incomplete": (drop_incomplete, "SELECT o_orderkey, 'any' AS rule FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'all' FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0"),
    "distinct_counts": (distinct_counts, "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, count(*) AS n FROM lineitem GROUP BY 1"),
    "clipped_fraction": (clipped_fraction, "SELECT l_returnflag, round(avg(CASE WHEN l_orderkey % 7 <> 0 AND l_quantity * 2 - 30 < 0 THEN 1 ELSE 0 END), 6) AS clipped FROM lineitem GROUP BY 1"),
}
