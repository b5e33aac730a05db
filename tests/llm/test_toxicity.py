import random
import zlib
from itertools import product

import numpy as np
from gridcast.llm import toxicity as T


def corpus(seed, n):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdeghiklmnoprst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["idiotic", "moronic", "zzfoul"] + ["qux" + w for w in plain[:30]]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 120))]
        label = int(i % 4 == 0)
        for _ in range(rng.randint(2, 5) * label):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words).capitalize() + ".", label))
    return rows


def enumerate_marginals(model, emit, at, n):
    trans = np.array(model.trans).reshape(2, 2)
    e = np.full(n, model.bias)
    e[at] += emit
    total, out = 0.0, np.zeros(n)
    for path in product((0, 1), repeat=n):
        w = np.exp(sum(e[i] for i in range(n) if path[i]) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        out += w * np.array(path)
    return out[at] / total


def test_marginals_are_those_of_the_whole_chain():
    rng = random.Random(1)
    for _ in range(60):
        model = T.Model(bias=rng.uniform(-3, 1), trans=tuple(rng.uniform(-2, 2) for _ in range(4)))
        n = rng.randint(1, 10)
        at = sorted(rng.sample(range(n), rng.randint(1, n)))
        emit = [rng.uniform(-2, 5) for _ in at]
        assert np.allclose(model.marginals(emit, at, n), enumerate_marginals(model, emit, at, n))


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(2)
    feats = [(np.array([0, 2, 2]), np.array([0, 1, 2])), (np.array([1], int), np.array([1], int)), (np.zeros(0, int), np.zeros(0, int))]
    labels = [np.array([1, 0, 1]), np.array([0, 1, 1, 0]), np.array([0])]
    p = rng.normal(size=3 + 5)
    for times in (None, [1, 4, 2]):
        chains = T.Chains(feats, labels, times)
        _, grad = T._likelihood(p, chains, 3)
        for i in range(len(p)):
            d = np.zeros_like(p)
            d[i] = 1e-6
            slope = (T._likelihood(p + d, chains, 3)[0] - T._likelihood(p - d, chains, 3)[0]) / 2e-6
            assert abs(slope - grad[i]) < 1e-5


def test_likelihood_is_that_of_all_paths():
    rng = np.random.default_rng(3)
    p = rng.normal(size=2 + 5)
    tok, fid, tags = np.array([0, 2]), np.array([1, 0]), [0, 1, 1]
    emit = np.full(3, p[2])
    np.add.at(emit, tok, p[fid])
    trans = p[3:].reshape(2, 2)
    value = lambda path: np.exp(sum(emit[i] for i in range(3) if path[i]) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
    want = -np.log(value(tags) / sum(value(path) for path in product((0, 1), repeat=3)))
    assert abs(T._likelihood(p, T.Chains([(tok, fid)], [np.array(tags)]), 2)[0] - want) < 1e-9


def test_held_out_documents_and_edges(spark):
    rows = corpus(1, 900)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(5000, None, "x", 1.0), (5001, "", "x", 1.0), (None, rows[0][1], "x", 1.0), (5002, "plain " * 30000 + "idiotic moronic zzfoul", "x", 1.0)], "doc_id long, text string, score string, predicted double")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels.filter(T.remainder(3) != 1))
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    held = {r["doc_id"] for r in labels.filter(T.remainder(3) == 1).select("doc_id").collect()}
    right = [got[i]["predicted"] == y for i, _, y in rows if i in held]
    assert sum(right) / len(right) > 0.97
    for i, text, y in rows:
        if y and got[i]["predicted"]:
            assert got[i]["spans"] and all(text[s["start"] : s["end"]].replace(" ", "").isalpha() for s in got[i]["spans"])
    assert got[5000]["score"] == got[5001]["score"] < 0.5 and got[5002]["predicted"] == 1
    assert got[None]["score"] == got[0]["score"]
    kept = {r["doc_id"] for r in T.filter_toxic(docs, model).collect()}
    assert kept == {i for i in got if got[i]["predicted"] == 0}
    assert T.score(docs.limit(0), model).count() == 0
    assert T.train(docs, labels.filter("toxic = 0")).score("idiotic")[0] < 0.5
    assert T.train(docs.limit(0), labels).weight == {}


def test_held_out_rows_of_the_test_tables(spark):
    """Through the query: recall and false alarms on rows that were not learned from, and its digest columns."""
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = T.op10_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows[:500]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and r["n_spans"] == len(r["spans"])
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    toxic, clean = [r["predicted"] for r in held if truth[r["doc_id"]] == 1], [r["predicted"] for r in held if truth[r["doc_id"]] == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_training_ignores_repeated_rows_and_their_order(spark):
    rows = corpus(2, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = T.train(docs, labels), T.train(docs.union(docs).repartition(5), labels.union(labels))
    assert a.weight.keys() == b.weight.keys() and np.allclose(list(a.weight.values()), list(b.weight.values())) and np.allclose(a.calib, b.calib)
