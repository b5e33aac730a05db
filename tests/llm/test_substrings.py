import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from gridcast.llm import substrings as S
from pyspark.sql import functions as F


def brute(rows, k):
    """(id, words, removed, hash of the rest) of (id, text) rows by a plain table of windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - k + 1):
            if i is not None and least[tuple(w[j : j + k])] < i:
                gone[j : j + k] = True
        rest = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=80, words="abcé"):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    passages = [[word() for _ in range(rng.randint(5, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            text += rng.choice(passages) + [word() for _ in range(rng.randint(0, 30))]
        rows.append((i * 3, rng.choice([" ", "  ", "\t", "\n"]).join(text)))
    full = [t for _, t in rows if len(t) > 200]
    return [*rows, (1, full[0]), (1000, full[0]), (1001, " " + full[1] + "\n"), (1002, "the " * 700), (4, "the " * 300), (1003, None), (1004, ""), (1005, " \n"), (1006, "\x0b".join(passages[0]) + "\x1cx\xa0y"), (None, full[2]), (None, None), (1007, full[2]), (1008, full[3]), (1008, full[3]), (1008, full[4] + " z")]


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(docs, **how).collect()
    for r in got:
        assert all(a["e"] < b["s"] for a, b in zip(r["removed_words"], r["removed_words"][1:], strict=False))
    return sorted(((r["doc_id"], r["n_words"], sum(x["e"] - x["s"] for x in r["removed_words"]), hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got), key=repr)


@pytest.mark.parametrize("how", [{}, {"k": 5, "m": 2, "run": 3}, {"k": 5, "m": 1, "hot": 40}, {"k": 8, "m": 8, "run": 1, "hot": 0}])
def test_equals_a_table_of_windows(spark, how):
    rows = corpus(7 + len(how))
    assert found(spark, rows, **how) == brute(rows, how.get("k", S.WINDOW))


def test_few_words_make_long_runs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(40)]
    assert found(spark, rows, k=6, m=2, run=16, hot=500) == brute(rows, 6)


def test_pieces_cover_every_window_once():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["x", "y", "zed", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    words, cuts = S.words_of(pa.array([None, *texts, " a  b "]))
    assert [b - a for a, b in zip(cuts, cuts[1:], strict=False)] == [0, *[len(t.split()) for t in texts], 2]
    start, size, h, c = S.super_kmers(S.word_hashes(words), cuts, 7, 3, 5)
    row = np.searchsorted(cuts, start, side="right") - 1
    at = sorted((r, s - cuts[r] + j) for r, s, n in zip(row, start, size, strict=True) for j in range(n))
    assert at == [(r, j) for r in range(len(cuts) - 1) for j in range(cuts[r + 1] - cuts[r] - 6)]
    flat, held = words.to_pylist(), {}
    for s, n, x, y in zip(start.tolist(), size.tolist(), h.tolist(), c.tolist(), strict=True):
        own = tuple(flat[s : s + n + 6])
        assert held.setdefault(y, own) == own  # equal hashes, equal words
        for j in range(n):
            assert held.setdefault(own[j : j + 7], x) == x  # equal windows, equal minimisers


def test_ranks_are_equal_for_equal_words_only():
    ids = np.random.default_rng(1).integers(0, 2, 400)
    for k in (1, 2, 5, 13, 16):
        rank = S.ranked(ids, k)
        seen = {}
        assert len(rank) == len(ids) - k + 1
        assert all(seen.setdefault(tuple(ids[i : i + k]), r) == r for i, r in enumerate(rank.tolist())) and len(set(seen.values())) == len(seen)


def test_long_texts_are_slices_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 300)
    rows = corpus(11, 30)
    assert found(spark, rows) == brute(rows, S.WINDOW)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 1, 9, 0, 2, 2)])], ["t"])
    assert [p.num_rows for p in S.sliced(batch, 0, 6)] == [2, 1, 3]


def test_empty_table_and_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, "q a b c d", 6, "y")], "doc_id long, text string, _id int, n_words string").withColumn("h", F.lit(1)).withColumn("want", F.lit("w"))
    got = sorted(S.remove_repeats(rows, k=3, m=1).collect())
    assert [(r["doc_id"], r["_id"], r["h"], r["want"], r["n_words"], r["kept_text"]) for r in got] == [(1, 5, 1, "w", 4, "a b c d"), (2, 6, 1, "w", 5, "q")]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = S.op11_substrings(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(S.SQL).fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, 13)
