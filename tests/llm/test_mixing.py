import numpy as np
from gridcast.llm import mixing as M


def rows(n=600):
    rng = np.random.default_rng(1)
    return [(i, "w " * int(rng.integers(1, 60)) + ("%%% 1 2 3" if i % 7 == 0 else ""), ["en", "de", None][i % 5 % 3], "hot" if i % 3 == 0 else f"s{i % 4}", i) for i in range(n)]


def test_raked_marginals_meet_targets():
    rng = np.random.default_rng(2)
    cells = [(s, lang, t) for s in "abc" for lang in "xy" for t in "pq"]
    weight = rng.uniform(1, 100, len(cells)).tolist()
    target = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.9, "q": 0.1}}
    got = M.rake(cells, weight, target, rounds=100)
    for d, name in enumerate(("source", "lang", "topic")):
        for value, share in target[name].items():
            assert abs(sum(w for c, w in zip(cells, got, strict=True) if c[d] == value) / sum(weight) - share) < 1e-9


def test_sample_follows_the_targets_and_keeps_columns(spark):
    docs = spark.createDataFrame([(*r, 1) for r in rows(3000)], "doc_id long, text string, lang string, source string, _m long, n int")
    got = M.weigh(docs.drop("_m"), rate=0.3).toPandas()
    raw = got.groupby("_source")["_tokens"].sum() ** M.ALPHA
    expected = (got["_p"] * got["_tokens"]).groupby(got["_source"]).sum()
    assert np.allclose(expected / expected.sum(), raw / raw.sum(), atol=1e-6)
    assert got["_p"].max() < 1 and abs((got["_p"] * got["_tokens"]).sum() / got["_tokens"].sum() - 0.3) < 1e-9
    drawn = M.sample(docs, rate=0.3)
    assert drawn.columns == docs.columns and drawn.count() == got["_kept"].sum()
    kept = got[got["_kept"]].groupby("_source")["_tokens"].sum()
    assert np.allclose(kept / kept.sum(), raw / raw.sum(), atol=0.05)


def test_distributed_raking_is_the_same(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n long")
    target = {"lang": {"en": 1.0, "de": 2.0, "": 1.0}}
    a = M.weigh(docs, targets=target, rounds=3).select("doc_id", "_p").toPandas().sort_values("doc_id")
    b = M.weigh(docs, targets=target, rounds=3, driver_cells=2).select("doc_id", "_p").toPandas().sort_values("doc_id")
    assert np.allclose(a["_p"], b["_p"])
    assert a["_p"].max() == 1.0


def test_calibration_takes_scarce_cells_whole():
    n, m = [100.0, 50.0, 1000.0], [5.0, 2.0, 0.5]
    for rate in (0.1, 0.5, 0.9):
        s = M.calibrate(n, m, rate)
        assert abs(sum(a * min(1.0, s * b) for a, b in zip(n, m, strict=True)) - rate * 1150) < 1e-9
    assert min(1.0, M.calibrate(n, m, 1.0) * 0.5) == 1.0


def test_nulls_empty_and_ties(spark):
    docs = spark.createDataFrame([(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, "word " * 20000, "en", "a")], "doc_id long, text string, lang string, source string")
    got = M.weigh(docs).collect()
    assert len(got) == 4 and {r["_topic"] for r in got} == {"empty", "prose"}
    assert M.weigh(docs.limit(0)).count() == 0
    assert M.weigh(docs.filter("doc_id = 1")).count() == 2


def test_default_sample_meets_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.weigh(docs).toPandas()
    for d in M.DIMS:
        whole = got.groupby(d)["_tokens"].sum()
        want = whole[whole > 0] ** M.ALPHA
        have = (got["_p"] * got["_tokens"]).groupby(got[d]).sum()[want.index]
        assert np.allclose(have / have.sum(), want / want.sum(), rtol=1.1 * M.TOLERANCE)
    assert 0 < (got["_p"] * got["_tokens"]).sum() < got["_tokens"].sum()


CLASHES = ["_m", "_tokens", "_p", "_topic", "_source", "_lang", "_kept", "_sum", "__row", "row", "Source_share"]


def test_sample_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(*r[:4], *(f"{c}{r[0]}" for c in CLASHES)) for r in rows(400)], ["doc_id", "text", "lang", "source", *CLASHES])
    got = M.sample(docs)
    plain = M.sample(docs.select("doc_id", "text", "lang", "source"))
    assert got.columns == docs.columns
    kept = got.collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in plain.collect()} and 0 < len(kept) < 400
    assert all(r[c] == f"{c}{r['doc_id']}" for r in kept for c in CLASHES)


def test_raking_stops_when_it_has_settled_and_not_before():
    rng = np.random.default_rng(5)
    cells = [(s, lang, t) for s in "abcd" for lang in "xyz" for t in "pq"]
    weight = rng.uniform(1, 1000, len(cells)).tolist()
    far = {"source": {"a": 0.97, "b": 0.01, "c": 0.01, "d": 0.01}, "topic": {"p": 0.99, "q": 0.01}}
    got = np.array(M.rake(cells, weight, far))
    for name, d in (("source", 0), ("topic", 2)):
        for v, share in far[name].items():
            assert abs(sum(w for c, w in zip(cells, got, strict=True) if c[d] == v) / sum(weight) - share) < 1e-9


def test_a_column_of_topics_can_be_given(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * 10, "en", "a", "x" if i % 10 else "y") for i in range(500)], "doc_id long, text string, lang string, source string, subject string")
    got = M.weigh(docs, topic_of=lambda _: F.col("subject"), targets={"topic": {"x": 0.5, "y": 0.5}}).toPandas()
    kept = (got["_p"] * got["_tokens"]).groupby(got["_topic"]).sum()
    assert abs(kept["x"] / kept.sum() - 0.5) < 0.01


def test_the_query_is_the_sql_and_meets_its_targets(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(M.SQL).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = M.op2_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    assert len(got) == len(want) and (got["kept"] == want["kept"]).all() and (got["topic"] == want["topic"]).all()
    for c in got.columns:
        if c not in ("kept", "topic"):
            assert np.allclose(got[c], want[c], atol=1e-9), c
    for name in ("source", "lang", "topic"):
        assert np.allclose(got[f"{name}_share"], got[f"{name}_target"], rtol=1.001 * M.TOLERANCE)
    assert got["kept"].sum() > 100
