import random
from functools import cache

import numpy as np
import pytest
import xxhash
from gridcast.llm import simhash as S


def slow_fingerprint(text, words=3):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=3):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def near(rng, base, flips):
    for b in rng.sample(range(64), flips):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("bucket", [20_000, 5])
def test_links_match_brute_force(spark, bucket):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(120)}
    for base in list(values)[:12]:
        values |= {near(rng, base, rng.randint(1, 5)) for _ in range(10)}
    centre = rng.getrandbits(64)
    values |= {near(rng, centre, rng.randint(0, 2)) for _ in range(60)} | {0}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), len(values), bucket=bucket)
    found = {r["node"]: r["component"] for r in S.components(got).collect()}
    label = slow_components({v - (1 << 64) if v >> 63 else v: v for v in sorted(values)})
    want = {v: label[v] for v in label}
    groups = lambda d: {frozenset(k for k in d if d[k] == r) for r in set(d.values())}
    assert groups({v: found.get(v, v) for v in signed}) == groups(want)


def test_counter_is_exact():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 200, np.uint64)
    fps[1:60] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 59).astype(np.uint64))
    planes, wanted = S.planes_of(fps), np.full(4, ~np.uint64(0))
    for radius in (0, 1, 3, 7):
        got = [i for i in S.within(planes, fps[0], wanted, radius) if i < 200]
        assert got == [i for i in range(200) if (int(fps[i]) ^ int(fps[0])).bit_count() <= radius]
        assert S.pairs_within(fps[:-1], fps[1:], radius).tolist() == [(int(a) ^ int(b)).bit_count() <= radius for a, b in zip(fps[:-1], fps[1:], strict=True)]


def test_documents_with_edges(spark):
    texts = [None, "", " \t", "One", "one", "a b", "A B c d e", "a b c d e", "é É x y", "w " * 30000, "x y z " * 5000, None]
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts += [" ".join(base)] * 3 + [" ".join(base[:200] + ["new"] + base[201:])]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "One", 1), (3, "One", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = S.near_duplicates(docs).collect()
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    label = slow_components(prints)
    assert len(got) == len(rows)
    for r in got:
        i = 3 if r["doc_id"] is None else r["doc_id"]
        assert (r["fp"] % (1 << 64), r["component_id"]) == (prints[i], label[i])
    assert S.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [20_000, 6])
def test_long_fingerprints_link_what_shares_a_block(spark, bucket):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (6, 2), np.uint64)
    rows = []
    for b in base:
        for _ in range(12):
            x = b.copy()
            for bit in rng.choice(128, rng.integers(0, 9), replace=False):
                x[bit // 64] ^= np.uint64(1 << int(bit % 64))
            rows.append(x)
    rows = np.unique(np.array(rows), axis=0)
    df = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(rows)], "id long, fp binary")
    got = {i: i for i in range(len(rows))} | {r["node"]: r["component"] for r in S.components(S.similar_links(df, 10, 2, bucket=bucket)).collect()}
    blocks = rows.view(np.uint16).reshape(len(rows), -1)
    label = {i: i for i in range(len(rows))}
    for _ in rows:
        for i in label:
            for j in label:
                if label[j] < label[i] and (blocks[i] == blocks[j]).any() and sum(int(a ^ b).bit_count() for a, b in zip(rows[i], rows[j], strict=True)) <= 10:
                    label[i] = label[j]
    assert got == label


def test_dedup_keeps_one_of_each_group_and_clean_documents(spark):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        rows.append((g, " ".join(base)))
        for c in range(g % 4):
            copy = base[:]
            for _ in range(3):
                copy[rng.randrange(300)] = "changed"
            rows.append((100 + 10 * g + c, " ".join(copy)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, "a"), (902, "a")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    kept = S.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(30)) <= set(ids) and ids.count(902) == 1 and 900 in ids and 901 not in ids and None not in ids
    assert sum(i is not None and 100 <= i < 900 for i in ids) <= 2
    assert S.dedup(docs.limit(0)).count() == 0


@cache
def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def at_similarity(rng, n, changed):
    """Two texts of ``n`` words that differ in their last ``changed``."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    return " ".join(words), " ".join(words[: n - changed] + [f"v{rng.randrange(10**9)}" for _ in range(changed)])


def test_dedup_finds_every_pair_at_the_similarity(spark):
    rng = random.Random(11)
    pairs = [at_similarity(rng, n, (n - 4) // 9) for n in (40, 300, 1000) for _ in range(40)]
    pairs += [(a, a + " z") for a, _ in (at_similarity(rng, 8, 0) for _ in range(40))]
    assert all(0.8 <= jaccard(*p) < 0.83 for p in pairs)
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    assert {r["doc_id"] for r in S.dedup(docs).collect()} == {2 * i for i in range(len(pairs))}


def test_dedup_leaves_what_is_less_similar(spark):
    rng = random.Random(12)
    pairs = [at_similarity(rng, 400, 50) for _ in range(40)]
    phrase = " ".join(f"p{i}" for i in range(20)) + " "
    pairs += [tuple(phrase * 20 + at_similarity(rng, 400, 0)[0] for _ in range(2)) for _ in range(10)]
    assert all(jaccard(*p) < 0.8 for p in pairs)
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    assert S.dedup(docs).count() == 2 * len(pairs)


def test_dedup_joins_what_a_failed_forest_edge_parts(spark):
    """Chains in one bucket over SMALL rows, whose forest has edges under the similarity."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    texts = []
    for _ in range(4):
        own = base[:]
        own[:60] = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        texts += [" ".join(own[:290 - k] + [f"w{rng.randrange(10**9)}" for _ in range(10 + k)]) for k in range(8)]
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    label = list(range(len(texts)))
    near = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if jaccard(a, b) >= 0.8]
    for _ in texts:
        for i, j in near:
            label[i] = min(label[i], label[j])
    assert len(set(label)) > 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in S.dedup(docs).collect()} == set(label)


def test_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(14)
    (a, near), (other, other_near) = at_similarity(rng, 300, 20), at_similarity(rng, 300, 20)
    docs = spark.createDataFrame([(1, a), (2, near), (2, "clean and on its own"), (3, other), (3, other_near)], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in S.dedup(docs).collect()}
    assert {(1, a), (2, "clean and on its own")} < kept and len(kept) == 3


def test_dedup_keeps_one_row_of_each_group_and_all_its_columns(spark):
    """Repeated rows, null ids, an id with two texts, and column names that the operator uses itself."""
    rows = [(1, "a a b c d e"), (5, "a a b c d e"), (5, "on its own"), (None, "a a b c d e"), (None, "without an id"), (None, "without an id"), (7, None), (7, None), (8, "")]
    names = ["_gone", "_hash", "_id", "__id", "id", "row", "root", "text_hash", "lowest", "fp"]
    docs = spark.createDataFrame([(i, t, *(f"{c}{n}" for c in names)) for n, (i, t) in enumerate(rows)], f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")
    kept = S.dedup(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", "a a b c d e"), ("5", "on its own"), ("7", None), ("None", "without an id")]
    for r in got:
        n = int(r["_gone"][5:])
        assert (r["doc_id"], r["text"]) == rows[n] and all(r[c] == f"{c}{n}" for c in names)


def test_a_bucket_that_stays_large_is_split(spark):
    """Fingerprints alike in all bits of a class: neither blocks nor classes part them."""
    rng = random.Random(21)
    values = sorted({sum((rng.random() < 0.5) << b for b in range(1, 64, 4)) for _ in range(400)})
    got = S.links(spark.createDataFrame([(v,) for v in values], "fp long"), len(values), bucket=40)
    found = {r["node"]: r["component"] for r in S.components(got).collect()}
    label = slow_components({v: v for v in values})
    groups = lambda d: {frozenset(k for k in d if d[k] == r) for r in set(d.values())}
    assert groups({v: found.get(v, v) for v in values}) == groups(label)
    keyed = spark.createDataFrame([(v, 1) for v in values], "id long, key long")
    assert max(r["count"] for r in S._dealt(keyed, 1, 40).groupBy("key").count().collect()) <= 80


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    label = slow_components(prints)
    rows = S.op3_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", label[i]) for i in texts} and len(rows) == len(texts)


def overlapping_sets(rng, n=60):
    """Sets around a few centres, at similarities to both sides of 0.8."""
    centres = [rng.integers(0, 1 << 63, 100, np.uint64) for _ in range(4)]
    out = []
    for _ in range(n):
        c = centres[rng.integers(4)]
        keep = rng.random(len(c)) < rng.choice([0.85, 0.9, 0.97])
        out.append(np.unique(np.concatenate((c[keep], rng.integers(0, 1 << 63, rng.integers(0, 9), np.uint64)))))
    return out


def groups_of(links, n):
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_a_block_of_sets_is_joined_as_all_its_pairs_join_it():
    rng = np.random.default_rng(31)
    sets = overlapping_sets(rng) + [np.zeros(0, np.uint64)] * 2
    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) and len(x)
    want = groups_of([(i, j) for i in range(62) for j in range(i) if alike(sets[i], sets[j])], 62)
    a, b = S.exact_forest(sets, np.arange(62), 0.8)
    assert all(alike(sets[i], sets[j]) for i, j in zip(a, b, strict=True)) and len(a) == 62 - len(set(want))
    assert groups_of(list(zip(a, b, strict=True)), 62) == want
    assert S.exact_forest(sets, np.zeros(62, int), 0.8) == ([], [])


def test_components_of_candidates_are_decided_in_blocks(spark):
    rng = np.random.default_rng(32)
    sets = overlapping_sets(rng)
    rows = spark.createDataFrame([(i, i, i % 2, bytearray(x.tobytes())) for i, x in enumerate(sets)], "id long, label long, comp long, held binary")
    got = [(r["u"], r["v"]) for r in S.decided(rows, 0.8, limit=700).collect()]
    pairs = [(i, j) for i in range(60) for j in range(i) if i % 2 == j % 2 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert groups_of(got, 60) == groups_of(pairs, 60) and {(max(p), min(p)) for p in got} <= set(pairs)


def test_dedup_finds_near_copies_by_their_fingerprints(spark, monkeypatch):
    """With the keys of the exact way taken away, the fingerprints alone find copies with three words of 300 changed."""
    rng = random.Random(41)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        copy = base[:]
        for at in (50, 150, 250):
            copy[at] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = S.sketches
    monkeypatch.setattr(S, "sketches", lambda *a: whole(*a).withColumn("keys", S.F.array().cast("array<long>")))
    assert {r["doc_id"] for r in S.dedup(docs).collect()} == {2 * g for g in range(12)}
