import math
import random
from collections import Counter

import numpy as np
import pytest
from gridcast.llm import search as S
from pyspark.sql import functions as F


def brute(rows, asked, k):
    tf = [Counter(S.terms_of(t or "")) for _, t in rows]
    mean = max(1.0, sum(sum(c.values()) for c in tf) / len(rows))
    df = Counter(w for c in tf for w in c)
    idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = {}
    for q in asked:
        found = []
        for (i, _), c in zip(rows, tf, strict=True):
            dl = sum(c.values())
            s = sum(idf[w] * c[w] * (S.K1 + 1) / (c[w] + S.K1 * (1 - S.B + S.B * dl / mean)) for w in tf[asked[q]] if w in c)
            if s > 0:
                found.append((-round(s, 9), i is None, i if i is not None else 0))
        out[q] = [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def texts(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    draw = lambda: vocab[min(399, int(rng.expovariate(0.02)))]
    rows = [(i, " ".join(draw() for _ in range(rng.randint(1, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "!!! ..."), (n + 3, rows[10][1]), (n + 4, rows[10][1]), (None, rows[10][1]), (n + 5, "w1é " * 20000)]


@pytest.mark.parametrize("shard,size", [(4000, 16 << 20), (37, 3000)])
def test_matches_scoring_everything(spark, shard, size):
    rows = texts(1)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rank int, terms string").repartition(3)
    asked = {i: at for at, (i, _) in enumerate(rows) if i is not None and i % 10 == 0}
    got = {}
    for r in S.search(docs, F.col("doc_id") % 10 == 0, k=5, shard_docs=shard, query_bytes=size).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    want = {q: x for q, x in brute(rows, asked, 5).items() if x}
    assert set(got) == set(want)
    for q in want:
        assert [(r, d) for r, d, _ in sorted(got[q])] == [(r, d) for r, d, _ in want[q]]
        assert np.allclose([s for *_, s in sorted(got[q])], [s for *_, s in want[q]], atol=2e-9)
    assert S.search(docs.limit(0), F.col("doc_id") % 10 == 0).count() == 0


def shard_of(rng, n=4000, v=200):
    held = rng.random((n, v)) < np.linspace(0.6, 0.002, v)
    start = np.concatenate(([0], np.cumsum(held.sum(1))))
    term = np.nonzero(held)[1].astype(np.int32)
    tf = rng.geometric(0.6, len(term)).astype(np.float32)
    idf = np.log(1 + (n - held.sum(0) + 0.5) / (held.sum(0) + 0.5))
    return S.Shard(held.sum(1).astype(float), start, term, tf, idf, held.sum(1).mean()), held.sum(0)


def every(shard, query):
    shard.wanted[query] = True
    score = shard.full(np.arange(shard.n))
    shard.wanted[query] = False
    return score


@pytest.mark.parametrize("query", [[0, 1, 2, 190, 195, 197, 199], [0, 1], [199], [5, 60], list(range(0, 200, 3))])
@pytest.mark.parametrize("floor", [0.0, 0.9, 1.1])
def test_a_shard_finds_what_scoring_everything_finds(query, floor):
    shard, _ = shard_of(np.random.default_rng(2))
    score = every(shard, np.array(query))
    least = np.sort(score)[-3]
    docs, found = shard.search(np.array(query), 3, floor * least)
    want = np.flatnonzero((score >= max(least, floor * least)) & (score > 0))
    assert sorted(docs) == want.tolist() and np.allclose(found, score[docs], atol=1e-9)


def test_pruning_opens_fewer_postings():
    shard, count = shard_of(np.random.default_rng(2))
    query = np.array([0, 1, 2, 190, 195, 197, 199])
    shard.search(query, 3)  # all that is read from the start, the first threshold included
    assert shard.opened < 0.2 * count[query].sum()
    before = shard.opened
    assert not len(shard.search(query, 3, 2 * shard.top[query].sum())[0]) and shard.opened == before  # a hopeless shard is not read


def test_blocks_under_the_threshold_are_skipped():
    """Documents of one half never hold the other half's common term, so none of their blocks is live."""
    n = 8 * S.BLOCK
    term = np.repeat([0, 1], n // 2).astype(np.int32)
    tf = np.ones(n, np.float32)
    tf[0] = 9
    shard = S.Shard(np.ones(n), np.arange(n + 1), term, tf, np.array([1.0, 1.0]), 1.0)
    reads = []
    shard.each = type("Rows", (), {"shape": shard.each.shape, "__getitem__": lambda _, at, rows=shard.each: reads.append(at) or rows[at]})()
    docs, _ = shard.search(np.array([0]), 1)
    assert docs.tolist() == [0]
    reads.clear()
    docs, _ = shard.search(np.array([0]), 1, shard.top[0] * 0.99)
    assert docs.tolist() == [0] and sum(at[1].stop - at[1].start for at in reads) == S.BLOCK


def test_many_queries_at_once_find_what_each_finds_alone():
    rng = np.random.default_rng(3)
    shard, _ = shard_of(rng)
    queries = [np.sort(rng.choice(200, rng.integers(1, 40), replace=False)) for _ in range(150)] + [np.array([0]), np.zeros(0, int)]
    floors = [0.0 if i % 3 else float(rng.uniform(1, 30)) for i in range(len(queries))]
    for query, floor, (docs, found) in zip(queries, floors, shard.search_all(queries, 4, floors), strict=True):
        score = every(shard, query)
        want = np.flatnonzero((score >= max(np.sort(score)[-4], floor)) & (score > 0))
        assert sorted(docs) == want.tolist() and np.allclose(found, score[docs], atol=1e-9)
    assert not shard.wanted.any()


def test_bounds_of_very_many_common_terms_leave_few_pivots():
    """Coarse steps (20 of them for 3,000 terms) would make pivots of most documents near the threshold."""
    rng = np.random.default_rng(4)
    n, v = 1000, 3000
    held = rng.random((n, v)) < 0.2
    start, term = np.concatenate(([0], np.cumsum(held.sum(1)))), np.nonzero(held)[1].astype(np.int32)
    tf = rng.geometric(0.6, len(term)).astype(np.float32)
    shard = S.Shard(held.sum(1).astype(float), start, term, tf, rng.uniform(1, 4, v), held.sum(1).mean())
    query = np.arange(0, v, 2)
    score, full, read = every(shard, query), shard.full, []
    shard.full = lambda docs, *bits: read.extend(docs) or full(docs, *bits)
    docs, _ = shard.search(query, 3, np.sort(score)[-3])
    assert sorted(docs) == np.sort(np.argsort(score)[-3:]).tolist() and len(set(read)) <= 6


def test_few_documents_of_very_many_terms_make_bounded_cells():
    v = 300_000
    shard = S.Shard(np.full(2, float(v)), np.array([0, v, 2 * v]), np.tile(np.arange(v, dtype=np.int32), 2), np.ones(2 * v, np.float32), np.ones(v), v)
    assert shard.each.size <= S.CELLS
    docs, found = shard.search(np.arange(0, v, 100), 1)
    assert sorted(docs) == [0, 1] and np.allclose(found, v / 100)


def test_queries_that_share_terms_are_neighbours():
    rng = np.random.default_rng(5)
    queries = [np.sort(rng.choice(50, 30, replace=False)) + 50 * int(rng.integers(3)) for _ in range(200)]
    order = S.alike(np.concatenate(queries), np.concatenate(([0], np.cumsum([len(q) for q in queries]))), np.ones(150))
    kinds = [int(queries[i][0]) // 50 for i in order]
    assert sorted(order) == list(range(200)) and sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) < 40  # about 130 by chance
    assert not len(S.alike(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0)))


def test_queries_and_edges(spark):
    docs = spark.createDataFrame([(100, "alpha beta"), (200, None), (300, ""), (400, "ALPHA  beta!"), (None, "alpha"), (400, "gamma"), (5, "beta " * 30_000)], "doc_id long, text string")
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in S.search(docs, F.col("doc_id") % 100 == 0, k=3).collect()]
    assert {q for q, *_ in got} == {100, 400} and [(r, d) for q, r, d in sorted(got) if q == 100][:2] == [(1, 100), (2, 400)]


def test_the_query_is_the_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {(q, r): (d, s) for q, r, d, s in db.execute(f"SELECT query_id, rank, doc_id, score FROM ({S.SQL})").fetchall()}
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in S.op6_search(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
