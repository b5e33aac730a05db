import random

from gridcast.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edits(rng, s):
    i, kind = rng.randrange(len(s)), rng.randrange(3)
    return s[:i] + rng.choice("abcz é") + s[i:] if kind == 0 else s[:i] + s[i + 1 :] if kind == 1 else s[:i] + rng.choice("qwé") + s[i + 1 :]


def test_within_one_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(8)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(8)))
        assert L.within_one(a, b) == (distance(a, b) <= 1)


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(18, 45))) for _ in range(40)]
    hot = "a line that very many documents have"
    rows = []
    for i in range(60):
        lines = [rng.choice(base) for _ in range(3)] + [edits(rng, rng.choice(base)) for _ in range(3)] + [edits(rng, edits(rng, rng.choice(base)))]
        lines += [hot if rng.random() < 0.6 else edits(rng, hot), "short", "short", "", hot.upper() + "  "]
        rng.shuffle(lines)
        rows.append((i * 3 % 61, "\n".join(lines), "x", 1))
    rows += [(100, None, "y", 2), (101, "", "y", 2), (102, "\n\n", "y", 2), (103, hot * 3000, "y", 2), (104, hot * 3000 + "!", "y", 2), (None, base[0], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, line int")
    got = {r["doc_id"]: r for r in L.dedup_lines(docs).collect()}
    seen, want = [], {}
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            want[i] = (None, 0, 0)
            continue
        keep, lines = [], text.split("\n")
        for line in lines:
            s = L.normal(line)
            if len(s) >= L.MIN_CHARS:
                gone = any(abs(len(s) - len(e)) <= 1 and (L.within_one(s, e)) for e in seen)
                seen.append(s)
                if gone:
                    continue
            keep.append(line)
        want[i] = ("\n".join(keep), len(lines), len(lines) - len(keep))
    assert {i: (r["text"], r["lines_total"], r["lines_removed"]) for i, r in got.items()} == want
    assert all(r["h"] in "xy" and r["line"] in (1, 2) for r in got.values())


def test_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, "the same line in both rows\nx"), (1, "the same line in both rows\nx"), (2, "The same  line in both rows")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["lines_removed"]) for r in L.dedup_lines(docs).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ["_th", "_seen", "_gone", "_at", "_gid", "_gth", "_bucket", "_bits", "__th", "gone", "h"]
    rows = [(i, f"a line that all of these documents have\nown line number {i * 1001}", *(f"{c}{i}" for c in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")
    got = L.dedup_lines(docs).collect()
    assert len(got) == 6 and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)
    assert all(r["lines_removed"] == (r["doc_id"] > 0) for r in got)


def test_the_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: (r["lines_total"], r["lines_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in L.dedup_lines(docs).collect()}
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in L.op4_lines(spark, sf).collect()} == want


def test_short_lines_enter_where_they_are_asked_for(spark):
    """Without a least length: every line of a character or more, against brute force."""
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (1, 2, 3, 4, 6, 9, 13, 19, 21) for _ in range(3)]
    rows = [(i, "\n".join([rng.choice(base) for _ in range(4)] + [edits(rng, rng.choice(base)) for _ in range(2)] + [""])) for i in range(25)]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=1).collect()}
    seen = []
    for i, text in rows:
        keep = []
        for line in text.split("\n"):
            s = L.normal(line)
            if s:
                gone = any(L.within_one(s, e) for e in seen)
                seen.append(s)
                if gone:
                    continue
            keep.append(line)
        assert got[i] == "\n".join(keep)
