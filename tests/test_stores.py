from pathlib import Path

import pytest
from gridcast.sources import stores as S
from pyspark.sql import functions as F


def rows(spark, *x, extra=""):
    return spark.createDataFrame(list(x), f"model string, fold int, mae double{extra}")


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def in_force(spark, path):
    held = S.pointer(spark, path)
    return {f for f in files(path) if any(f.startswith(d) for d in held["folders"].values())}


def content(spark, path):
    return sorted(map(tuple, S.read_store(spark, path).collect()), key=repr)


def test_an_upsert_leaves_other_buckets_files(spark, tmp_path):
    path = str(tmp_path / "s")
    S.upsert_store(spark.range(400).select(F.concat(F.lit("m"), "id").alias("model"), F.lit(None).cast("int").alias("fold"), F.col("id").cast("double").alias("mae")), path, ["model", "fold"])
    before, held = in_force(spark, path), S.pointer(spark, path)
    assert len(held["folders"]) == S.BUCKETS
    S.upsert_store(rows(spark, ("m7", None, -1.0), ("m7", None, -1.0)), path, ["model", "fold"])
    after, now = in_force(spark, path), S.pointer(spark, path)
    changed = {b for b in held["folders"] if held["folders"][b] != now["folders"][b]}
    assert len(changed) == 1 and {f for f in before if f"_bucket={next(iter(changed))}/" not in f} <= after
    got = S.read_store(spark, path)
    assert got.count() == 400 and got.filter("model = 'm7'").first()["mae"] == -1.0
    S.upsert_store(rows(spark, ("new", 1, 5.0)).limit(0), path, ["model", "fold"])
    assert S.pointer(spark, path) == now  # no rows, no change
    S.upsert_store(rows(spark, ("new", 1, 5.0)), path, ["model", "fold"])
    assert S.read_store(spark, path).count() == 401


def test_a_reader_never_misses_the_table(spark, tmp_path):
    """What was opened before a commit can be read after it, and again after the next for what was in force then."""
    path = str(tmp_path / "s")
    S.upsert_store(rows(spark, ("a", 1, 1.0)), path, ["model"])
    opened = S.read_store(spark, path)
    S.upsert_store(rows(spark, ("a", 1, 2.0)), path, ["model"])
    assert opened.first()["mae"] == 1.0 and S.read_store(spark, path).first()["mae"] == 2.0
    for k in range(3, 7):
        S.publish(rows(spark, ("a", 1, float(k))), path, ["model"])
    assert content(spark, path) == [("a", 1, 6.0)]
    assert len(list(Path(path).glob("_point-*"))) == 2 and len(files(path)) == 2  # this commit's and the one before


@pytest.mark.parametrize("step", ["_write", "_write_text", "_commit"])
def test_a_stopped_writer_leaves_the_old_rows(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "s")
    S.upsert_store(rows(spark, ("a", 1, 1.0), ("b", 1, 2.0)), path, ["model"])
    want = content(spark, path)

    def stop(*_, **__):
        raise RuntimeError("stopped")

    real = getattr(S, step)

    def late(*a, **k):
        real(*a, **k)
        stop()

    for broken in (stop, late) if step != "_commit" else (stop,):
        with monkeypatch.context() as m:
            m.setattr(S, step, broken)
            with pytest.raises(RuntimeError):
                S.upsert_store(rows(spark, ("a", 1, 9.0), ("c", 1, 9.0)), path, ["model"])
            with pytest.raises(RuntimeError):
                S.publish(rows(spark, ("z", 1, 9.0)), path, ["model"])
        assert content(spark, path) == want
    S.upsert_store(rows(spark, ("a", 1, 9.0)), path, ["model"])
    assert content(spark, path) == [("a", 1, 9.0), ("b", 1, 2.0)]
    monkeypatch.setattr(S, "ORPHAN_SECONDS", -1)
    S.upsert_store(rows(spark, ("a", 1, 8.0)), path, ["model"])
    assert content(spark, path) == [("a", 1, 8.0), ("b", 1, 2.0)]


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    S.upsert_store(rows(spark, ("a", 1, 1.0)), path, ["model"])
    held = S.pointer(spark, path)
    S.upsert_store(rows(spark, ("a", 1, 2.0)), path, ["model"])
    with pytest.raises(OSError, match="another writer"):
        S._commit(spark, path, held, held)
    assert content(spark, path) == [("a", 1, 2.0)]


def test_replace_keys_and_columns(spark, tmp_path):
    path = str(tmp_path / "s")
    S.publish(rows(spark, ("a", 1, 1.0), ("b", 2, 2.0), ("b", None, 3.0)), path, ["model", "fold"])
    S.replace_store(rows(spark, ("c", 3, 9.0)), path, F.col("fold") == 2)
    assert content(spark, path) == [("a", 1, 1.0), ("b", None, 3.0), ("c", 3, 9.0)]
    S.replace_store(rows(spark, ("c", 1, 1.0)).limit(0), path, F.col("model") == "c")
    assert content(spark, path) == [("a", 1, 1.0), ("b", None, 3.0)]
    S.upsert_store(rows(spark, ("d", 1, 1.0, "n"), extra=", note string"), path, ["model", "fold"])
    assert content(spark, path) == [("a", 1, 1.0, None), ("b", None, 3.0, None), ("d", 1, 1.0, "n")]
    with pytest.raises(ValueError, match="keys"):
        S.upsert_store(rows(spark, ("d", 1, 1.0)), path, ["model"])
    with pytest.raises(ValueError, match="mae"):
        S.upsert_store(spark.createDataFrame([("d", 1, "x")], "model string, fold int, mae string"), path, ["model", "fold"])
    with pytest.raises(FileNotFoundError):
        S.read_store(spark, str(tmp_path / "none"))
    empty = str(tmp_path / "e")
    S.publish(spark.createDataFrame([], "a int"), empty)
    assert S.store_exists(spark, empty) and S.read_store(spark, empty).count() == 0
    S.replace_store(spark.createDataFrame([(1,)], "a int"), empty, F.col("a") == 1)
    assert content(spark, empty) == [(1,)]
