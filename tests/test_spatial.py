import numpy as np
import pytest
from gridcast.functions import EARTH_KM_CLUSTER
from gridcast.operators import spatial
from gridcast.queries import registry
from pyspark.sql import functions as F


def points(spark, at):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "id long, lat double, lon double")


def brute(at, km):
    """The smallest point that each can reach by steps of the radius."""
    lat, lon = np.radians(np.array(at)).T
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * EARTH_KM_CLUSTER * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) <= km
    label = np.arange(len(at))
    while True:
        now = np.where(near, label, len(at)).min(1)
        if (now == label).all():
            return label
        label = now


def clusters(df, km):
    got = spatial.density_clusters(df, "id", km).collect()
    first = {}
    for r in sorted(got):
        first.setdefault(r["cluster"], r["id"])
    assert sorted(first) == list(range(len(first)))
    return [first[r["cluster"]] for r in sorted(got)]


@pytest.mark.parametrize(("centre", "spread", "km"), [((51.3, 11.4), 0.6, 6.0), ((0.0, 0.0), 0.5, 5.0), ((-72.0, -100.0), 1.5, 8.0), ((51.0, 11.0), 0.05, 0.3)])
def test_cells_have_the_components_of_all_pairs(spark, centre, spread, km):
    rng = np.random.default_rng(int(km * 10))
    at = [tuple(np.round(np.array(centre) + rng.uniform(-spread, spread, 2), 4)) for _ in range(260)]
    at += at[:20] + [(centre[0] + spread * 0.01 * k, centre[1]) for k in range(20)]
    assert clusters(points(spark, at), km) == brute(at, km).tolist()


def test_blocks_of_crowded_cells(spark):
    rng = np.random.default_rng(2)
    at = [(51 + a, 11 + b) for a, b in rng.normal(0, 0.004, (120, 2))] + [(51 + a, 11.05 + b) for a, b in rng.normal(0, 0.004, (120, 2))]
    df, want = points(spark, at), brute(at, 1.2)
    edges = spatial.cell_edges(df, "id", 1.2, block=10)
    got = {r["id"]: r["component"] for r in spatial.connected(edges, df, "id").collect()}
    assert [got[i] for i in range(len(at))] == want.tolist()


def test_edges_are_linear_in_a_crowded_place(spark):
    n = 100_000
    df = spark.range(n).select("id", (F.lit(51.0) + F.randn(1) * 0.01).alias("lat"), (F.lit(11.0) + F.randn(2) * 0.01).alias("lon"))
    edges = spatial.cell_edges(df, "id", 6.0)
    assert n - 1 <= edges.count() <= n + 100


def test_search_ends_as_all_pairs_do():
    rng = np.random.default_rng(3)
    for k in range(60):
        a, b = rng.uniform(0, 0.02, (300, 2)), rng.uniform(0, 0.02, (200, 2)) + [0, 0.02 + 0.0002 * k]
        h = np.sin((a[:, None, 0] - b[:, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[:, 0]) * np.sin((a[:, None, 1] - b[:, 1]) / 2) ** 2
        for limit in (h.min(), h.min() * 0.999, h.min() * 1.001):
            assert spatial.any_within(a, b, limit, 8) == (h <= limit).any()


def test_the_rings_of_the_queries_make_the_edges_of_their_sql(spark):
    """The geometry and the SQL of way_rings once shared a name, so that the later of the two hid the first."""
    want = sorted((p, *a, *b) for p, _, pts in registry.RINGS for a, b in zip(pts, pts[1:] + pts[:1], strict=True) if a[1] != b[1])
    assert sorted(map(tuple, registry._edges(spark).collect())) == want and len(want) == 9
    assert [r["poly"] for r in registry.missing_districts(spark, "/root/testdata/sf0.001").collect()] == ["north"]


RADIUS_TOTALS = {"n": F.sum, "kw": F.sum, "nearest": F.min, "farthest": F.max}


def test_totals_within_a_radius_are_those_of_all_pairs(spark):
    """Shared places, repeated and null sites, and sites that nothing is near to."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), "ab"[i % 2], float(i)) for i, (a, b) in enumerate(np.round(rng.uniform(51, 51.4, (300, 2)) - [0, 40], 1))] + [(None, 11.0, "a", 1.0), (51.1, 11.1, "b", None)]
    own = spark.createDataFrame(rows, "lat double, lon double, kind string, kw double")
    places = [(i % 9, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.uniform(51, 51.4, (12, 2)) - [0, 40], 1))] + [(3, 51.1, 11.1), (20, 51.1, 11.1), (21, None, 11.1), (22, -10.0, 11.0)]
    sites = spark.createDataFrame(places, "site long, site_lat double, site_lon double")
    got = spatial.radius_totals(own, sites, 9.0, ["kind"], {"n": F.count(F.lit(1)), "kw": F.sum("kw")}, RADIUS_TOTALS)
    want = spatial.radius_join(own, sites, 9.0).groupBy("site", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("kw").alias("kw"), F.min("km").alias("nearest"), F.max("km").alias("farthest"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_a_crowded_place_is_one_row_of_a_radius(spark, tmp_path):
    """20,000 suppliers near 400,000 customers in two places: eight thousand million pairs."""
    spark.range(400_000).select((F.col("id") * 7820).alias("c_custkey"), F.lit(1.5).alias("c_acctbal"), F.lit(1).alias("c_nationkey"), F.lit("x").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20_000).select((F.col("id") * 660).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    near = registry.haversine_radius(spark, str(tmp_path)).agg(F.count("site"), F.min("n"), F.max("n"), F.max("kw")).first()
    assert tuple(near) == (20_000, 400_000, 400_000, 600_000.0)
    fleet = registry.fleet_nameplate(spark, str(tmp_path)).agg(F.count("site"), F.min("nodes"), F.max("mw")).first()
    assert tuple(fleet) == (20_000, 1, 600.0)
