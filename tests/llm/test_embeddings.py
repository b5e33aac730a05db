import math

import numpy as np
import pytest
from gridcast.llm import embeddings as E


def brute(rows, threshold=0.95):
    good = {}
    for at, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[at] = x / np.sqrt((x * x).sum())
    links = {at: set() for at in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    label = {}
    for at in range(len(rows)):
        seen, stack = {at}, [at]
        while stack:
            for b in links[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        label[at] = min(ids) if ids else None
    return links, label


@pytest.mark.parametrize("block", [2000, 7])
def test_matches_brute_force(spark, block):
    rng = np.random.default_rng(3)
    f32 = lambda v: [float(x) for x in np.asarray(v, np.float32)]
    base = rng.normal(size=(150, 16))
    rows = [f32(v) for v in base]
    rows += [f32(v + rng.normal(size=16) * rng.uniform(0.02, 0.3)) for v in base[:60]]
    rows += [f32(base[0] + rng.normal(size=16) * 0.05) for _ in range(40)] + [f32(base[1])] * 30 + [f32(2 * base[2])]
    rows += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [1.0, 0.01], f32(base[3])]
    rows = [(i * 7 % 1009, v) for i, v in enumerate(rows)] + [(None, f32(base[4])), (5, f32(base[5])), (5, f32(base[5]))]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, id string, n int")
    links, label = brute(rows)
    got = E.near_duplicates(df, block=block, miss=1e-6).collect()
    want = sorted((str(i), len(links[at]), str(label[at]), i == label[at]) for at, (i, _) in enumerate(rows))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == want
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_double_and_single_precision_meet(spark):
    v = [0.1, 0.7, 0.3, 0.2]
    rows = [(1, v), (2, [float(np.float32(x)) for x in v]), (3, [-x for x in v])]
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_recall_at_the_threshold(spark):
    """At the default: thousands of planted pairs with cosines just over the threshold, among vectors that link with nothing."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    n, dim = 3000, 64
    a, noise = unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    b = unit(noise - (noise * a).sum(1, keepdims=True) * a)
    cosine = rng.uniform(0.9501, 0.96, n)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    rows = np.concatenate((a, b, unit(rng.normal(size=(2000, dim)))))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in E.near_duplicates(df).collect()}
    found = sum(got[i]["n_links"] == got[n + i]["n_links"] == 1 and got[n + i]["component_id"] == i for i in range(n))
    assert found >= 0.99 * n
    assert all(got[i]["n_links"] == 0 for i in range(2 * n, len(rows)))


def test_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links, label = brute(rows)
    got = E.op5_embeddings(spark, sf).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted((i, len(links[at]), label[at], i == label[at]) for at, (i, _) in enumerate(rows))
