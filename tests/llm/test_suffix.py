import random
from collections import Counter

import numpy as np
import pytest
from gridcast.llm import suffix as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((len(d), int(gone.sum()), len(edge) // 2, S.digest(bytes(np.frombuffer(d, np.uint8)[~gone]))))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[0]] * 5 + [texts[1][:40] + "x" + texts[1][41:]] * 2 + [None, "", "ab" * 300, "q" * 400, "short", passages[0] * 3]
    return texts


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 90))).encode() for _ in range(40)] + [b"\xff\x00\xff" * 20] * 2
    sym, _ = S.symbols(parts)
    word = S.packed(sym)
    for depth in (7, 20, 200):
        sa, place, shared = S.suffix_array(word, depth)
        tails = [tuple(sym[i : i + depth]) for i in sa]
        assert tails == sorted(tails) and sorted(sa) == list(range(len(sym))) and (sa[place] == np.arange(len(sym))).all()
    for cap in (5, 30):
        lcp = S.common_prefixes(word, sa, place, shared, cap, lanes=7)
        for k in range(1, len(sa)):
            a, b = sym[sa[k] :], sym[sa[k - 1] :]
            n = next((x for x in range(min(len(a), len(b), cap)) if a[x] != b[x]), min(len(a), len(b), cap))
            assert lcp[k] == n


@pytest.mark.parametrize("length", [20, 21])
def test_shards_find_what_counting_finds(length):
    rng = random.Random(2)
    for _ in range(20):
        make = lambda: ["".join(rng.choice("ab") for _ in range(rng.randint(1, 80))).encode() for _ in range(12)]  # noqa: E731, B023
        one, two = make(), make()
        two[0] = one[0][:40] + two[0]
        grams = lambda parts: Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        flat = lambda parts, test: [i + length <= len(p) and test(p[i : i + length]) for p in parts for i in range(len(p) + 1)]
        a, b = grams(one), grams(two)
        assert S.repeated(one, length).tolist() == flat(one, lambda w: a[w] > 1)
        hit_a, hit_b = S.merged(one, two, length)
        assert hit_a.tolist() == flat(one, lambda w: b[w] > 0) and hit_b.tolist() == flat(two, lambda w: a[w] > 0)


def test_only_contexts_that_can_match_are_compared():
    rng = random.Random(6)
    noise = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    gram, left = noise(S.GRAM), noise(92)
    parts = [left + gram + noise(150), noise(10) + left + gram + noise(120), noise(100) + gram + noise(150), noise(50) + gram + noise(60)]
    anchor = int(S.gram_hashes(np.frombuffer(gram, np.uint8)).view(np.int64)[0])
    assert S.partnered([anchor] * 4, parts) == [0, 1]


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abc ") for _ in range(3000))
    h, a, b = S.anchors(np.frombuffer(data, np.uint8), 40)
    assert a[0] == 0 and b[-1] == 3000 - 40 and (a[1:] == b[:-1] + 1).all()
    of = np.repeat(h, b - a + 1)
    for p in range(0, 2900, 37):
        own, _, _ = S.anchors(np.frombuffer(data[p : p + 40], np.uint8), 40)
        assert own.tolist() == [of[p]]


@pytest.mark.parametrize("shard", [S.SHARD, 600])
def test_against_brute_force(spark, shard):
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)] + [(None, texts[3], 0, "x")], "doc_id long, text string, a int, spans string")
    got = S.remove_repeats(docs, length=60, shard=shard).collect()
    want = brute([*texts, texts[3]], 60)
    assert len(got) == len(want)
    for r in got:
        i = len(texts) if r["doc_id"] is None else r["doc_id"]
        assert (r["text_bytes"], sum(s["e"] - s["s"] for s in r["removed_spans"]), len(r["removed_spans"]), S.digest(bytes(r["kept_bytes"]))) == want[i]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_the_query_on_test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], 200), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.op1_suffix(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_columns_of_any_name_stay(spark):
    names = ["_data", "_spans", "_t", "_st", "_seen", "_at", "__data", "bits", "bucket", "t", "spans"]
    rows = [(i, t, *(f"{c}{i}" for c in names)) for i, t in enumerate(corpus(9, 20))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")
    got = S.remove_repeats(docs, length=60).collect()
    assert len(got) == len(rows) and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)
    want = brute([r[1] for r in rows], 60)
    assert all((r["text_bytes"], S.digest(bytes(r["kept_bytes"]))) == (want[r["doc_id"]][0], want[r["doc_id"]][3]) for r in got)


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a hash of a few values every text shares its key with others; each is keyed again until it stands alone."""
    from pyspark.sql import functions as F

    plain = F.xxhash64
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: F.pmod(plain(*c), F.lit(7 if len(c) == 1 else 1 << 40)))
    data = spark.createDataFrame([(f"text {i % 30}".encode(),) for i in range(60)], "_data binary")
    shared, texts = S.text_keys(data)
    assert shared and sorted(r["k"] for r in texts.collect()) == [2] * 30 and texts.select("t").distinct().count() == 30
