"""Registry cleaning, spatial operators and power curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clip, haversine, power_law, snap
from ..operators import clean, outlines, physics, spatial
from .common import ASSETS, HAVERSINE, SITES, assets, rounded, sites, t


def registry_filter_impute(spark, d):
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    reg = c.select(k.alias("unit"), F.when(k % 3 == 0, "1400").when(k % 3 == 1, "14").otherwise("9").alias("state"), F.when(k % 5 == 0, "").when(k % 5 == 1, None).when(k % 5 == 2, "31").otherwise("35").alias("s1"), F.when(k % 2 == 0, "35").otherwise("31").alias("s2"), F.col("c_nationkey").cast("string").alias("plz"), F.when(k % 7 != 0, F.lit(51.3) + (k % 230) / 100.0).alias("lat"), F.when(k % 11 != 0, F.lit(11.3) + (k % 340) / 100.0).alias("lon"))
    n = t(spark, d, "nation")
    post = n.select(F.when(F.col("n_nationkey") < 15, F.col("n_nationkey").cast("string")).otherwise("unknown").alias("plz"), (F.lit(50.0) + F.col("n_nationkey") / 10.0).alias("lat"), (F.lit(10.0) + F.col("n_nationkey") / 10.0).alias("lon"), F.lit(0).alias("ord"))
    post = post.union(post.withColumn("lat", F.col("lat") + 1).withColumn("ord", F.lit(1)))
    out = clean.impute_coordinates(clean.registry_filter(reg, "state", "s1", "s2"), post, "plz", (52.4, 13.2))
    return rounded(out.select("unit", "plz", "lat", "lon", "imputed"))


def snap_grid(spark, d):
    a = spatial.with_node(assets(spark, d))
    return rounded(a.select("asset", "node_lat", "node_lon"))


def cluster_node_map(spark, d):
    nodes = spatial.with_node(assets(spark, d)).groupBy("node_lat", "node_lon").agg(F.count(F.lit(1)).alias("n_assets"))
    s = sites(spark, d).select("site", snap("site_lat").alias("node_lat"), snap("site_lon").alias("node_lon"))
    return rounded(s.join(nodes, ["node_lat", "node_lon"]))


def grid_clusters(spark, d):
    return rounded(spatial.grid_clusters(assets(spark, d), "kw"))


def weighted_centroids(spark, d):
    a = assets(spark, d).withColumn("kw", F.when(F.col("nation") == 3, 0.0).otherwise(F.col("kw")))
    return rounded(spatial.weighted_centroids(a, ["nation"], "kw"))


def haversine_radius(spark, d):
    own = {"n": F.count(F.lit(1)), "kw": F.sum("kw")}
    return rounded(spatial.radius_totals(assets(spark, d), sites(spark, d), 8.0, [], own, {"n": F.sum, "kw": F.sum, "nearest": F.min, "farthest": F.max}))


def fleet_nameplate(spark, d):
    a = spatial.with_node(assets(spark, d))
    own = {"kw": F.sum("kw"), "nodes": F.collect_set(F.struct("node_lat", "node_lon"))}
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))  # noqa: E731  # the nodes that a radius reaches are few
    near = spatial.radius_totals(a, sites(spark, d), 8.0, ["segment"], own, {"kw": F.sum, "nodes": union})
    return rounded(near.select("site", "segment", (F.col("kw") / 1000).alias("mw"), F.size("nodes").alias("nodes")))


#: Two neighbouring squares, one of them with a hole, and a triangle (test geometry).
RINGS = [("west", 0, [(11.5, 51.5), (13.0, 51.5), (13.0, 53.0), (11.5, 53.0)]), ("west", 1, [(12.0, 52.0), (12.5, 52.0), (12.5, 52.5), (12.0, 52.5)]), ("east", 0, [(13.0, 51.5), (14.5, 51.5), (14.5, 53.0), (13.0, 53.0)]), ("tri", 0, [(11.8, 51.35), (14.2, 51.45), (12.7, 52.9)])]


def _edges(spark):
    rows = [(p, r, i, x, y) for p, r, pts in RINGS for i, (x, y) in enumerate(pts)]
    return spatial.polygon_edges(spark.createDataFrame(rows, "poly string, ring int, pos int, x double, y double"))


EDGES = "edges(poly, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{p}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for p, _, pts in RINGS for a, b in zip(pts, pts[1:] + pts[:1], strict=True)) + ")"
INSIDE = f"WITH {ASSETS}, {EDGES}, inside AS (SELECT asset, poly FROM (SELECT asset, poly, count(*) AS n FROM assets JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2) WHERE n % 2 = 1)"


def point_in_polygon(spark, d):
    return spatial.point_in_polygon(assets(spark, d), _edges(spark), "asset")


def district_fleets(spark, d):
    a = spatial.with_node(assets(spark, d))
    own = spatial.point_in_polygon(a, _edges(spark), "asset")
    return rounded(a.join(own, "asset").groupBy("poly").agg((F.sum("kw") / 1000).alias("mw"), F.count(F.lit(1)).alias("n"), F.countDistinct("node_lat", "node_lon").alias("nodes")))


def missing_districts(spark, d):
    reg = spark.createDataFrame([("west",), ("east",), ("tri",), ("north",)], "poly string")
    return reg.join(district_fleets(spark, d), "poly", "left_anti")


def eps_components(spark, d):
    s = sites(spark, d).select(F.col("site").alias("id"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))
    return rounded(spatial.density_clusters(s, "id", 6.0))


def way_rings(spark, d):
    """Outlines around the suppliers, cut into ways of three edges that come in any order, every other one reversed, put together and measured."""
    s = sites(spark, d).withColumn("m", (F.lit(9) + F.col("site") % 4 * 3).cast("int"))
    corner = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m"))))
    turn = 2 * F.pi() * (F.col("k") % F.col("m")) / F.col("m")
    points = corner.select(F.col("site").cast("string").alias("poly"), "k", "m", (F.col("site_lon") + F.cos(turn) * 0.01).alias("x"), (F.col("site_lat") + F.sin(turn) * 0.02).alias("y"))
    # A corner between two ways belongs to both.
    here = F.floor(F.col("k") / 3)
    ways = points.withColumn("w", F.explode(F.when(F.col("k") % 3 != 0, F.array(here)).when(F.col("k") == 0, F.array(here)).when(F.col("k") == F.col("m"), F.array(here - 1)).otherwise(F.array(here - 1, here))))
    ways = ways.select("poly", F.lit("outer").alias("role"), (F.col("w") * 7 % 22 + 1).cast("long").alias("way"), F.when(F.col("w") % 2 == 0, F.col("k")).otherwise(-F.col("k")).alias("pos"), "x", "y")
    return rounded(outlines.ring_measures(outlines.assemble(ways)).select("poly", "n", "area", "length"))


WAY_RINGS = f"""WITH {SITES}, p AS (SELECT CAST(site AS VARCHAR) AS poly, k, 9 + site % 4 * 3 AS m, site_lon + cos(2 * pi() * (k % (9 + site % 4 * 3)) / (9 + site % 4 * 3)) * 0.01::DOUBLE AS x, site_lat + sin(2 * pi() * (k % (9 + site % 4 * 3)) / (9 + site % 4 * 3)) * 0.02::DOUBLE AS y FROM sites, range(19) r(k) WHERE k <= 9 + site % 4 * 3)
SELECT a.poly, count(*) AS n, round(abs(sum(a.x * b.y - b.x * a.y)) / 2, 6) AS area, round(sum(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))), 6) AS length FROM p a JOIN p b ON a.poly = b.poly AND b.k = a.k + 1 GROUP BY 1"""


#: A reference curve with cut-in 3, rated 13 and cut-out 25 m/s (test curve).
CURVE = [(3.0, 0.0), (5.0, 180.0), (7.0, 620.0), (9.0, 1280.0), (11.0, 1820.0), (13.0, 2000.0), (25.0, 2000.0)]


def _curve(spark):
    return spark.createDataFrame([(1, v, kw) for v, kw in CURVE], "curve int, v double, kw double")


SEGMENT = "seg AS (SELECT v AS a, kw AS ka, lead(v) OVER (ORDER BY v) AS b, lead(kw) OVER (ORDER BY v) AS kb FROM (VALUES " + ", ".join(f"({v}::DOUBLE, {kw}::DOUBLE)" for v, kw in CURVE) + ") c(v, kw))"


def _speeds(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.lit(1).alias("curve"), F.when(F.col("l_orderkey") % 13 != 0, F.col("l_quantity") * 0.6).alias("v_in"))


def power_curve_interp(spark, d):
    p = physics.power_at(_speeds(spark, d), _curve(spark), ["curve"])
    return rounded(p.groupBy(F.round("v_in", 6).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.avg("kw").alias("kw")))


def capped_power(spark, d):
    p = physics.power_at(_speeds(spark, d), _curve(spark), ["curve"])
    gross = F.when(F.col("l_linenumber") == 1, 0.0).when(F.col("l_linenumber") == 2, 1500.0)
    return rounded(p.withColumn("capped", physics.capped_power("kw", gross, F.lit(2000.0))).groupBy("l_linenumber").agg(F.sum("capped").alias("kw"), F.count("capped").alias("n")))


def cubic_curve(spark, d):
    p = physics.cubic_power_at(_speeds(spark, d), [v for v, _ in CURVE], [k for _, k in CURVE])
    return rounded(p.groupBy("l_linenumber").agg(F.avg("kw").alias("kw")))


def _second_derivatives(knots):
    """Of the natural cubic spline through the knots, by elimination along the three diagonals."""
    x, y = zip(*knots, strict=True)
    h = [b - a for a, b in zip(x, x[1:], strict=False)]
    slope = [(b - a) / w for a, b, w in zip(y, y[1:], h, strict=False)]
    up, right = [0.0], [0.0]
    for i in range(1, len(x) - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * up[-1]
        right.append((6 * (slope[i] - slope[i - 1]) - h[i - 1] * right[-1]) / pivot)
        up.append(h[i] / pivot)
    m = [0.0] * len(x)
    for i in range(len(x) - 2, 0, -1):
        m[i] = right[i] - up[i] * m[i + 1]
    return m


def _spline_sql():
    m = _second_derivatives(CURVE)
    rows = ", ".join(f"({x0}::DOUBLE, {x1}::DOUBLE, {y0}::DOUBLE, {y1}::DOUBLE, {m0!r}::DOUBLE, {m1!r}::DOUBLE)" for (x0, y0), (x1, y1), m0, m1 in zip(CURVE, CURVE[1:], m, m[1:], strict=False))
    value = "m0 * pow(x1 - v, 3) / (6 * (x1 - x0)) + m1 * pow(v - x0, 3) / (6 * (x1 - x0)) + (y0 / (x1 - x0) - m0 * (x1 - x0) / 6) * (x1 - v) + (y1 / (x1 - x0) - m1 * (x1 - x0) / 6) * (v - x0)"
    return f"""WITH c(x0, x1, y0, y1, m0, m1) AS (VALUES {rows}), li AS (SELECT l_linenumber, CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity * 0.6::DOUBLE END AS v FROM lineitem)
SELECT l_linenumber::BIGINT AS l_linenumber, round(avg(CASE WHEN v IS NOT NULL THEN coalesce({value}, 0) END), 6) AS kw FROM li LEFT JOIN c ON v >= x0 AND (v < x1 OR (v = x1 AND x1 = {CURVE[-1][0]})) GROUP BY 1"""


def curve_unpivot(spark, d):
    w = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("kW at 3 m/s"), F.col("p_retailprice").alias("kW at 10.5 m/s"), F.when(F.col("p_partkey") % 2 == 0, F.lit(1.0)).alias("kW at 25 m/s"))
    return rounded(physics.unpivot_curves(w, ["p_partkey"]))


def hub_extrapolation(spark, d):
    li = t(spark, d, "lineitem")
    return rounded(li.groupBy("l_linenumber").agg(F.avg(power_law(F.col("l_quantity"), F.lit(50.0) + F.col("l_linenumber") * 20)).alias("v")))


def turbine_match(spark, d):
    # A registry of models: one curve for each brand and type, with the smallest key as file order.
    p = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("curve"), F.min("p_name").alias("name"), F.max("p_size").alias("size"), F.max("p_retailprice").alias("price"))
    curves = p.select("curve", F.col("curve").alias("ord"), F.col("p_brand").alias("maker"), F.concat("name", F.lit(" "), F.col("size").cast("string")).alias("turbine"), (F.col("price") * 2).alias("rated_kw"))
    c = t(spark, d, "customer")
    q = F.col("c_custkey")
    own = c.select(q.alias("asset"), F.when(q % 4 != 0, F.concat(F.lit("Brand#"), (q % 25).cast("string"))).alias("manufacturer"), F.when(q % 3 == 0, "ring").when(q % 3 == 1, "").alias("type"), F.when(q % 5 != 0, F.lit(1800.0) + q % 20 * 40).alias("gross_kw"), F.when(q % 7 != 0, (q % 50).cast("double")).alias("rotor"))
    return rounded(physics.match_turbines(own, curves).select("asset", "score", F.coalesce("curve", F.lit(-1)).alias("curve")))


MATCH = """WITH p AS (SELECT p_brand, p_type, min(p_partkey) AS curve, min(p_name) AS name, max(p_size) AS size, max(p_retailprice) AS price FROM part GROUP BY 1, 2),
c AS (SELECT curve, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS cm, regexp_replace(lower(name || ' ' || size), '[^a-z0-9]', '', 'g') AS ct, try_cast(nullif(regexp_extract(name || ' ' || size, '(\\d+)', 1), '') AS DOUBLE) AS cr, price * 2 AS rated FROM p),
a AS (SELECT c_custkey AS asset, regexp_replace(lower(coalesce(CASE WHEN c_custkey % 4 <> 0 THEN 'Brand#' || c_custkey % 25 END, '')), '[^a-z0-9]', '', 'g') AS m, CASE WHEN c_custkey % 3 = 0 THEN 'ring' ELSE '' END AS t, CASE WHEN c_custkey % 5 <> 0 THEN 1800 + c_custkey % 20 * 40 END::DOUBLE AS kw, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 END::DOUBLE AS ro FROM customer),
s AS (SELECT asset, curve, CASE WHEN m <> '' AND cm <> '' AND (contains(m, cm) OR contains(cm, m)) THEN 10 ELSE 0 END AS mk, m <> '' AND contains(cm, m) AS own, abs(rated - kw) AS gap,
 CASE WHEN abs(rated - kw) < 0.15 * kw AND kw > 0 THEN 5 * (1 - abs(rated - kw) / (0.15 * kw)) ELSE 0 END + CASE WHEN abs(cr - ro) < 0.10 * ro AND ro > 0 THEN 5 * (1 - abs(cr - ro) / (0.10 * ro)) ELSE 0 END + CASE WHEN t <> '' AND ct <> '' AND (contains(t, ct) OR contains(ct, t)) THEN 8 ELSE 0 END AS rest FROM a, c),
o AS (SELECT *, bool_or(own) OVER (PARTITION BY asset) AS anyown FROM s),
f AS (SELECT asset, any_value(anyown) AS anyown, max(mk + rest) FILTER (own OR NOT anyown) AS s1, arg_min(curve, (-(mk + rest), curve)) FILTER (own OR NOT anyown) AS c1, max(rest) AS s2, arg_min(curve, (-rest, curve)) AS c2, arg_min(curve, (gap, curve)) FILTER (gap IS NOT NULL) AS c3 FROM o GROUP BY 1)
SELECT asset, round(CASE WHEN anyown AND s1 < 15 AND s2 > s1 THEN s2 ELSE s1 END, 6)::DOUBLE AS score, coalesce(CASE WHEN (CASE WHEN anyown AND s1 < 15 AND s2 > s1 THEN s2 ELSE s1 END) >= 5 THEN CASE WHEN anyown AND s1 < 15 AND s2 > s1 THEN c2 ELSE c1 END ELSE c3 END, -1) AS curve FROM f"""


def _node_hours(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 20).cast("int").alias("node"), F.col("l_shipdate").alias("ts")).agg(F.avg("l_quantity").alias("v_in"), F.avg("l_discount").alias("sw")).withColumn("curve", F.lit(1))


def _capacity(spark, d):
    s = t(spark, d, "supplier")
    return s.select((F.col("s_suppkey") % 23).cast("int").alias("node"), (F.abs("s_acctbal") / 1000).alias("capacity_mw"))


def regional_prior_sum(spark, d):
    w = physics.power_at(_node_hours(spark, d).withColumn("v_in", F.col("v_in") / 3.6), _curve(spark), ["curve"])
    per = w.withColumn("pu", physics.wind_per_unit("v_in", "kw", 2000.0))
    return rounded(physics.regional_sum(per, _capacity(spark, d), ["node"], "ts", "pu"))


def solar_prior_sum(spark, d):
    per = _node_hours(spark, d).withColumn("pu", physics.solar_per_unit(F.col("sw") * 8000))
    return rounded(physics.regional_sum(per, _capacity(spark, d), ["node"], "ts", "pu"))


def regional_weather_mean(spark, d):
    return rounded(physics.regional_mean(_node_hours(spark, d), _capacity(spark, d), ["node"], "ts", ["v_in", "sw"]))


def solar_geometry(spark, d):
    ev = t(spark, d, "events")
    z, a = physics.solar_position("ts", F.lit(52.4), F.lit(13.2))
    return rounded(ev.select("event_id", z.alias("zenith"), a.alias("azimuth"), physics.clear_sky(z).alias("ghi")), 5)


def solar_fleet(spark, d):
    own = sites(spark, d).select("site", F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))
    f = physics.solar_fleet(own, "2024-03-30 00:00:00", "2024-04-01 00:00:00", "1 hour")
    return rounded(f.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg("zenith").alias("zenith"), F.avg("ghi").alias("ghi"), F.max("ghi").alias("peak")), 5)


SOLAR_FLEET = f"""WITH {SITES}, t AS (SELECT unnest(generate_series(TIMESTAMP '2024-03-29 23:00:00', TIMESTAMP '2024-03-31 22:00:00', INTERVAL 1 HOUR)) AS ts),
x AS (SELECT site, site_lat AS lat, site_lon AS lon, hour(ts) + 0.0::DOUBLE AS hr, 2 * pi() / 365 * (dayofyear(ts) - 1 + (hour(ts) - 12) / 24.0::DOUBLE) AS g FROM sites, t),
y AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq FROM x),
w AS (SELECT site, sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians((hr * 60 + eq + 4 * lon) / 4 - 180)) AS cz FROM y),
v AS (SELECT site, degrees(acos(cz)) AS z, CASE WHEN cz > 0 THEN 1098.0 * cz * exp(-0.057 / cz) ELSE 0 END AS ghi FROM w)
SELECT site, count(*) AS n, round(avg(z), 5) AS zenith, round(avg(ghi), 5) AS ghi, round(max(ghi), 5) AS peak FROM v GROUP BY 1"""

SOLAR = """WITH g AS (SELECT event_id, hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE AS hr, dayofyear(ts) AS doy FROM events),
x AS (SELECT *, 2 * pi() / 365 * (doy - 1 + (hr - 12) / 24) AS g FROM g),
y AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq FROM x),
z AS (SELECT *, radians((hr * 60 + eq + 4 * 13.2) / 4 - 180) AS ang FROM y),
w AS (SELECT *, sin(radians(52.4)) * sin(dec) + cos(radians(52.4)) * cos(dec) * cos(ang) AS cz FROM z)
SELECT event_id, round(degrees(acos(cz)), 5) AS zenith, round(degrees(atan2(sin(ang), cos(ang) * sin(radians(52.4)) - tan(dec) * cos(radians(52.4)))) + 180, 5) AS azimuth, round(CASE WHEN cz > 0 THEN 1098.0 * cz * exp(-0.057 / cz) ELSE 0 END, 5)::DOUBLE AS ghi FROM w"""

_KM = HAVERSINE.format(r=6371.0, lat1="lat", lon1="lon", lat2="site_lat", lon2="site_lon")
_KMC = HAVERSINE.format(r=6371.0088, lat1="a.site_lat", lon1="a.site_lon", lat2="b.site_lat", lon2="b.site_lon")
_NH = "nh AS (SELECT (l_suppkey % 20)::INT AS node, l_shipdate AS ts, avg(l_quantity) AS v, avg(l_discount) AS sw FROM lineitem GROUP BY 1, 2), cap AS (SELECT (s_suppkey % 23)::INT AS node, sum(abs(s_acctbal) / 1000) AS cap FROM supplier GROUP BY 1)"
_POWER = "CASE WHEN {v} IS NULL THEN NULL ELSE coalesce((SELECT ka + (kb - ka) * ({v} - a) / (b - a) FROM seg WHERE {v} >= a AND ({v} < b OR ({v} = b AND b = 25))), 0) END"
_LI = "li AS (SELECT l_linenumber, CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity * 0.6::DOUBLE END AS v FROM lineitem), p AS (SELECT l_linenumber, li.v, CASE WHEN li.v IS NULL THEN NULL ELSE coalesce(ka + (kb - ka) * (li.v - a) / (b - a), 0) END AS kw FROM li LEFT JOIN seg ON li.v >= a AND (li.v < b OR (li.v = b AND b = 25)))"

QUERIES = {
    "registry_filter_impute": (registry_filter_impute, """WITH r AS (SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey % 5 <= 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '35' ELSE '31' END WHEN c_custkey % 5 = 2 THEN '31' ELSE '35' END AS st,
CASE WHEN c_custkey % 7 <> 0 THEN 51.3::DOUBLE + (c_custkey % 230) / 100.0::DOUBLE END AS lat, CASE WHEN c_custkey % 11 <> 0 THEN 11.3::DOUBLE + (c_custkey % 340) / 100.0::DOUBLE END AS lon FROM customer WHERE c_custkey % 3 < 2)
SELECT k AS unit, n::VARCHAR AS plz, round(CASE WHEN lat IS NULL OR lon IS NULL THEN CASE WHEN n < 15 THEN 50 + n / 10.0::DOUBLE ELSE 52.4::DOUBLE END ELSE lat END, 6) AS lat, round(CASE WHEN lat IS NULL OR lon IS NULL THEN CASE WHEN n < 15 THEN 10 + n / 10.0::DOUBLE ELSE 13.2::DOUBLE END ELSE lon END, 6) AS lon, (lat IS NULL OR lon IS NULL) AS imputed FROM r WHERE st = '35'"""),
    "snap_grid": (snap_grid, f"WITH {ASSETS} SELECT asset, round_even(lat / 0.1::DOUBLE, 0)::BIGINT AS node_lat, round_even(lon / 0.1::DOUBLE, 0)::BIGINT AS node_lon FROM assets"),
    "cluster_node_map": (cluster_node_map, f"WITH {ASSETS}, {SITES}, n AS (SELECT round_even(lat / 0.1::DOUBLE, 0)::BIGINT AS node_lat, round_even(lon / 0.1::DOUBLE, 0)::BIGINT AS node_lon, count(*) AS n_assets FROM assets GROUP BY 1, 2) SELECT s.node_lat, s.node_lon, site, n_assets FROM (SELECT site, round_even(site_lat / 0.1::DOUBLE, 0)::BIGINT AS node_lat, round_even(site_lon / 0.1::DOUBLE, 0)::BIGINT AS node_lon FROM sites) s JOIN n USING (node_lat, node_lon)"),
    "grid_clusters": (grid_clusters, f"WITH {ASSETS}, c AS (SELECT round_even(lat / 0.1::DOUBLE, 0)::BIGINT AS cell_lat, round_even(lon / 0.1::DOUBLE, 0)::BIGINT AS cell_lon, sum(kw) / 1000 AS capacity_mw, count(*) AS assets, coalesce(sum(lat * kw) / nullif(sum(kw), 0), avg(lat)) AS centroid_lat, coalesce(sum(lon * kw) / nullif(sum(kw), 0), avg(lon)) AS centroid_lon FROM assets GROUP BY 1, 2) SELECT cell_lat, cell_lon, round(capacity_mw, 6) AS capacity_mw, assets, round(centroid_lat, 6) AS centroid_lat, round(centroid_lon, 6) AS centroid_lon, row_number() OVER (ORDER BY cell_lat, cell_lon) - 1 AS cluster FROM c"),
    "weighted_centroids": (weighted_centroids, f"WITH {ASSETS}, z AS (SELECT * REPLACE (CASE WHEN nation = 3 THEN 0 ELSE kw END AS kw) FROM assets) SELECT nation::BIGINT AS nation, round(sum(kw) / 1000, 6) AS capacity_mw, count(*) AS assets, round(coalesce(sum(lat * kw) / nullif(sum(kw), 0), avg(lat)), 6) AS centroid_lat, round(coalesce(sum(lon * kw) / nullif(sum(kw), 0), avg(lon)), 6) AS centroid_lon FROM z GROUP BY 1"),
    "haversine_radius": (haversine_radius, f"WITH {ASSETS}, {SITES}, p AS (SELECT *, {_KM} AS km FROM assets, sites) SELECT site, count(*) AS n, round(sum(kw), 6) AS kw, round(min(km), 6) AS nearest, round(max(km), 6) AS farthest FROM p WHERE km <= 8 GROUP BY 1"),
    "fleet_nameplate": (fleet_nameplate, f"WITH {ASSETS}, {SITES}, p AS (SELECT *, {_KM} AS km FROM assets, sites) SELECT site, segment, round(sum(kw) / 1000, 6) AS mw, count(DISTINCT (round_even(lat / 0.1::DOUBLE, 0), round_even(lon / 0.1::DOUBLE, 0))) AS nodes FROM p WHERE km <= 8 GROUP BY 1, 2"),
    "point_in_polygon": (point_in_polygon, f"{INSIDE} SELECT asset, poly FROM inside"),
    "district_fleets": (district_fleets, f"{INSIDE} SELECT poly, round(sum(kw) / 1000, 6) AS mw, count(*) AS n, count(DISTINCT (round_even(lat / 0.1::DOUBLE, 0), round_even(lon / 0.1::DOUBLE, 0))) AS nodes FROM inside JOIN assets USING (asset) GROUP BY 1"),
    "missing_districts": (missing_districts, "SELECT 'north' AS poly"),
    "eps_components": (eps_components, f"""WITH RECURSIVE {SITES}, e AS (SELECT a.site AS a, b.site AS b FROM sites a, sites b WHERE {_KMC} <= 6 OR a.site = b.site),
r AS (SELECT site AS id, site AS root FROM sites UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(root) AS c FROM r GROUP BY 1) SELECT id, dense_rank() OVER (ORDER BY c) - 1 AS cluster FROM m"""),
    "way_rings": (way_rings, WAY_RINGS),
    "power_curve_interp": (power_curve_interp, f"WITH {SEGMENT}, {_LI} SELECT round(v, 6) AS v, count(*) AS n, round(avg(kw), 6) AS kw FROM p GROUP BY round(v, 6)"),
    "capped_power": (capped_power, f"WITH {SEGMENT}, {_LI}, c AS (SELECT l_linenumber, CASE WHEN kw IS NOT NULL THEN least(greatest(kw, 0), CASE WHEN l_linenumber = 2 THEN 1500 ELSE 2000 END) END AS x FROM p) SELECT l_linenumber::BIGINT AS l_linenumber, round(sum(x), 6) AS kw, count(x) AS n FROM c GROUP BY 1"),
    "cubic_curve": (cubic_curve, _spline_sql()),
    "curve_unpivot": (curve_unpivot, "SELECT p_partkey, p_size::DOUBLE AS kw, 3.0::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, round(p_retailprice, 6), 10.5 FROM part UNION ALL SELECT p_partkey, 1.0, 25.0 FROM part WHERE p_partkey % 2 = 0"),
    "hub_extrapolation": (hub_extrapolation, "SELECT l_linenumber::BIGINT AS l_linenumber, round(avg(l_quantity * pow((50 + l_linenumber * 20) / 100.0::DOUBLE, 0.14)), 6) AS v FROM lineitem GROUP BY 1"),
    "turbine_match": (turbine_match, MATCH),
    "regional_prior_sum": (regional_prior_sum, f"WITH {SEGMENT}, {_NH}, p AS (SELECT node, ts, coalesce(ka + (kb - ka) * (v / 3.6::DOUBLE - a) / (b - a), 0) AS kw FROM nh LEFT JOIN seg ON v / 3.6::DOUBLE >= a AND (v / 3.6::DOUBLE < b OR (v / 3.6::DOUBLE = b AND b = 25))) SELECT ts, round(coalesce(sum(least(greatest(kw / 2000, 0), 1) * cap), 0), 6) AS prior_mw FROM p JOIN cap USING (node) GROUP BY 1"),
    "solar_prior_sum": (solar_prior_sum, f"WITH {_NH} SELECT ts, round(coalesce(sum(sw * 8000 / 1000 * 0.8::DOUBLE * cap), 0), 6) AS prior_mw FROM nh JOIN cap USING (node) GROUP BY 1"),
    "regional_weather_mean": (regional_weather_mean, f"WITH {_NH} SELECT ts, round(avg(v), 6) AS v_in, round(avg(sw), 6) AS sw FROM nh WHERE node IN (SELECT node FROM cap) GROUP BY 1"),
    "solar_geometry": (solar_geometry, SOLAR),
    "solar_fleet": (solar_fleet, SOLAR_FLEET),
}
