import math
import random

import duckdb
import numpy as np
import pytest
from gridcast.llm import negatives as N
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=10, positives=5, negatives=5, low=80, high=100):
    """The contract over (vec_id, embedding, label), without relabelling; equal rows count once."""
    sound = sorted({(i, tuple(math.floor(256 * c) for c in v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for a, x, y in sound:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), i, z) for i, v, z in sound if len(v) == len(x))
        for s, i, z in [r for r in scored if r[2] == y and r[1] != a][:positives]:
            fit = [r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a, i, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


def rows_of(seed, n, dim=6, scale=1.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    make = lambda: [scale * (c + rng.gauss(0, 0.3)) for c in rng.choice(centre)]
    return [(i, make(), rng.choice([0, 0, 0, 1, 2])) for i in range(n)]


def mined(spark, rows, every=10, **how):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, N.mine(docs, F.col("id") % every == 0, **how).collect()))


@pytest.mark.parametrize("how", [{}, {"block": 4}, {"positives": 1, "negatives": 40, "low": 20, "high": 90}])
def test_equals_sorting_all_scores(spark, how):
    rows = rows_of(1, 260)
    copies = [(1000 + i, rows[3][1], 1 + i % 2) for i in range(90)] + [(2000 + i, rows[0][1], rows[0][2]) for i in range(20)]
    odd = [(3000, None, 1), (3010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3020, [math.nan] * 6, 1), (3030, [math.inf] + [0.0] * 5, 1), (3040, rows[0][1], None), (None, rows[0][1], 1), (3050, [], 1), (3051, [], 1), (3052, [], 2), (3060, [0.5, 0.5], 2), (3061, [0.5, 0.4], 2), (3062, [0.5, 0.45], 0), (3070, [0.0] * 6, 1), (4000, rows[1][1], 9)]
    rows += copies + odd + [rows[0], rows[0], rows[5], (10, rows[7][1], 1), (10, rows[8][1], 0)]
    assert mined(spark, rows, **how) == brute(rows, **{k: v for k, v in how.items() if k != "block"})


def test_large_components_stay_exact(spark):
    rows = rows_of(2, 60, dim=3, scale=3e4) + [(100, [2.0**21 + 0.001, 1.0, -1.0], 1), (101, [2.0**21, 1.0, 3.0], 1), (102, [2.0**21, 1.0, 2.0], 0)]
    assert mined(spark, rows) == brute(rows)
    assert N.scores(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 3.0], [-(2.0**31), 1.0]])).tolist() == [[2**60 + 3, 1 - 2**61]]
    with pytest.raises(OverflowError):
        N.scores(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_radix_finds_the_kth_score():
    rng = np.random.default_rng(4)
    score = rng.integers(-500, 500, 4000)
    for k in (1, 7, 300):
        w = N.Windows(np.array([0, 1, 2]), np.array([-500, 100, 499]), np.array([499, 160, 400]), False, k)
        for digit in range(w.digits):
            shift = (w.digits - 1 - digit) * w.step
            parts = [(i, b) for i in range(3) if w.open[i] for b in ((w.hi[i] - score[(score >= w.lo[i]) & (score <= w.hi[i])] - w.base[i]) >> shift).tolist() if 0 <= b < 1 << w.step]
            keys = sorted(set(parts))
            w.refine(np.array([i for i, _ in keys], int), np.array([b for _, b in keys], int), np.array([parts.count(x) for x in keys], int), shift)
        assert not w.width[2]
        for i in (0, 1):
            own = np.sort(score[(score >= w.lo[i]) & (score <= w.hi[i])])[::-1]
            if len(own) < k:
                assert w.base[i] == w.width[i]
            else:
                assert w.hi[i] - w.base[i] == own[k - 1] and w.need[i] == k - (own > own[k - 1]).sum()


def test_empty_and_clashing_names(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    rows = rows_of(6, 40)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS window", "3 AS v", "4 AS block", "5 AS score", "6 AS x")
    assert sorted(map(tuple, N.mine(docs, F.col("id") % 10 == 0).collect())) == brute(rows)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, N.op13_negatives(spark, sf).collect()))
    rel = con.execute(N.SQL)
    assert [d[0] for d in rel.description] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got == sorted(rel.fetchall()) and got
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == brute(rows, 100)
