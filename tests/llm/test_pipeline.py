import corpus_pipeline as P
import pytest


def test_stages_keep_their_promises(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    toxic, clean = ({r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter(f"toxic = {y}").collect()} for y in (1, 0))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == len(P.STAGES) - 1:
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= before.keys()
        if k == 0:
            assert len(clean - after.keys()) <= 0.02 * len(clean) and len(toxic & after.keys()) <= 0.2 * len(toxic)
        elif k == 1:
            assert after.keys() == before.keys()
            for i, t in after.items():
                kept = iter(before[i].split("\n"))
                assert t == "" or all(any(x == y for y in kept) for x in t.split("\n"))
        else:
            assert all(after[i] == before[i] for i in after)
        before = after
    pieces = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in pieces) <= 1024
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == before.keys()


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


SF = "/root/testdata/sf0.001"
OWN = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves, in any case.
CLASHES = ["_m", "_tokens", "_p", "_kept", "_th", "_seen", "_gone", "_at", "_hash", "_id", "__row", "row", "id", "spans", "score", "GONE", "lines", "h", "key", "bucket"]
LINE = "a passage that stands in several of these documents"


def edges(spark):
    plain = [
        (1, f"{LINE}\nfirst of its kind and quite long enough to stay", "en", "a"),
        (2, f"{LINE}\nsecond of its kind, with other words altogether here", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, "word " * 40_000 + "end", "de", "b"),
        (6, "repeated row of several words and more", "de", "a"),
        (6, "repeated row of several words and more", "de", "a"),
        (None, "a text without an id, which is on its own", "fr", None),
        (7, "one id with a text that nobody else has at all", "fr", "c"),
        (7, "one id with quite another text, equally alone", "fr", "c"),
    ]
    rows = [(i, t, lang, source, len(t or ""), *(f"{c}-{n}" for c in CLASHES)) for n, (i, t, lang, source) in enumerate(plain)]
    return spark.createDataFrame(rows, OWN + "".join(f", {c} string" for c in CLASHES)), plain


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_edges_of_each_stage(spark, name, stage):
    """Nulls, empty and very long texts, ties and repeated rows, an id with two texts, clashing names, an empty table."""
    docs, plain = edges(spark)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    at = [int(r["_m"].rpartition("-")[2]) for r in got]
    assert len(set(at)) == len(at)  # no row twice
    for r, n in zip(got, at, strict=True):
        assert r["doc_id"] == plain[n][0] and all(r[c] == f"{c}-{n}" for c in CLASHES)
        if name != "line_dedup":
            assert r["text"] == plain[n][1]
    text = {n: r["text"] for r, n in zip(got, at, strict=True)}
    if name == "toxicity":
        assert set(at) == set(range(10))
    elif name == "line_dedup":
        assert set(at) == set(range(10)) and text[0] == plain[0][1] and text[1] == plain[1][1].split("\n")[1]
        assert text[2] is None and text[3] == "" and all(text[n] == plain[n][1] for n in range(4, 10))
        assert all(r["n_chars"] == len(r["text"] or "") for r in got)
    elif name == "simhash_dedup":
        # A null text and an empty one have no words and count as copies; of the repeated rows one stays.
        assert set(at) in ({0, 1, 2, 4, 5, 7, 8, 9}, {0, 1, 2, 4, 6, 7, 8, 9})
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0


def test_edges_of_the_last_stage(spark):
    docs, plain = edges(spark)
    got = P.STAGES[-1][1](spark, docs, SF).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert {i for i, _ in pieces} == {i for i, *_ in plain} and sum(n for own in pieces.values() for _, n in own) >= 40_000
    assert pieces[(3, 1)] == [(0, 1)] and pieces[(4, 1)] == [(0, 1)] and len([k for k in pieces if k[0] == 7]) == 2
    assert P.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
