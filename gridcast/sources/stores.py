"""Stores that change only what an upsert touches.

A store is a folder with Parquet data by bucket of its keys, and small pointer files, ``_point-{n}``, of which the last names the folder of every
bucket. An upsert writes the buckets that it touches to new folders and then one new pointer, in one rename: until then readers have the old rows, from
then on the new ones, and a writer that stops at any step leaves the old ones in force. Other buckets' files stay as they are. Folders that no
pointer names any more go one commit later, so a reader that began before a commit can end its scan.

Overwriting partitions in place (Spark's dynamic mode) deletes before it renames; a stop between the two loses the partition, so it isn't used. Pointers are no
log: they hold the folders, the keys and the columns. One writer at a time; a second one that meets the same number raises.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import replace_where, upsert
from .writers import _fs

BUCKETS = 16
ORPHAN_SECONDS = 24 * 3600
MARK = "_point-"


def _points(spark: SparkSession, path: str) -> list[str]:
    """Names of the pointers, oldest first."""
    jpath, fs = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.getPath().getName().startswith(MARK))


def _read_text(spark: SparkSession, path: str) -> str:
    jpath, fs = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jpath, fs = _fs(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What is in force: number, keys, buckets, schema (JSON), folders by bucket. None where there is no store."""
    for _ in range(5):  # the last pointer may go while it is read
        names = _points(spark, path)
        if not names:
            return None
        try:
            return json.loads(_read_text(spark, f"{path}/{names[-1]}")) | {"number": int(names[-1].removeprefix(MARK))}
        except Exception:  # noqa: BLE001
            if _points(spark, path)[-1:] == names[-1:]:
                raise
    raise OSError(f"{path} changes faster than it can be read")


def _commit(spark: SparkSession, path: str, held: dict | None, new: dict) -> None:
    """Put the new pointer in force, then drop what only pointers before the last one named."""
    number = held["number"] + 1 if held else 0
    here, staged = f"{path}/{MARK}{number:09d}", f"{path}/_new-{uuid.uuid4().hex}"
    _write_text(spark, staged, json.dumps(new))
    jpath, fs = _fs(spark, here)
    if fs.exists(jpath) or not fs.rename(_fs(spark, staged)[0], jpath):
        fs.delete(_fs(spark, staged)[0], False)
        raise OSError(f"another writer has changed {path}")
    kept = {*new["folders"].values(), *(held["folders"].values() if held else ())}
    for name in _points(spark, path):
        if int(name.removeprefix(MARK)) < number - 1:
            gone = set(json.loads(_read_text(spark, f"{path}/{name}"))["folders"].values()) - kept
            for folder in gone:
                fs.delete(_fs(spark, f"{path}/{folder}")[0], True)
            fs.delete(_fs(spark, f"{path}/{name}")[0], False)
    _drop_orphans(spark, path, kept)


def _drop_orphans(spark: SparkSession, path: str, kept: set[str]) -> None:
    """Folders of writers that stopped long ago, and commits of which nothing is left in force."""
    data, fs = _fs(spark, f"{path}/data")
    if not fs.exists(data):
        return
    live = {f.split("/")[1] for f in kept}
    for s in fs.listStatus(data):
        name, old = s.getPath().getName(), time.time() - s.getModificationTime() / 1000 > ORPHAN_SECONDS
        if name not in live and (old or not [c for c in fs.listStatus(s.getPath()) if c.isDirectory()]):
            fs.delete(s.getPath(), True)


def _folders(spark: SparkSession, path: str, held: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(held["schema"]))
    paths = [f"{path}/{f}" for b, f in sorted(held["folders"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows in force now; later commits don't change what this frame reads."""
    held = pointer(spark, path)
    if held is None:
        raise FileNotFoundError(path)
    return _folders(spark, path, held)


def store_exists(spark: SparkSession, path: str) -> bool:
    return bool(_points(spark, path))


def _bucket(keys: list[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def _write(df: DataFrame, path: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Write rows by bucket to a new commit's folder: bucket -> folder. Buckets of many rows are dealt to several tasks."""
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    df.withColumn("_bucket", _bucket(keys, buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    jpath, fs = _fs(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()]
    return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}


def _joined(old: str | None, new: T.StructType, path: str) -> T.StructType:
    """The columns of both; a column that changes its type raises."""
    fields = list(T.StructType.fromJson(json.loads(old)).fields) if old else []
    known = {f.name: f.dataType for f in fields}
    for f in new.fields:
        if known.setdefault(f.name, f.dataType) != f.dataType:
            raise ValueError(f"the column {f.name} of {path} is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(n, k, True) for n, k in known.items()])


def publish(df: DataFrame, path: str, keys: list[str] | None = None, buckets: int | None = None) -> None:
    """Exchange the whole table in one step, whatever was there."""
    spark = df.sparkSession
    held, keys = pointer(spark, path), list(keys or [])
    buckets = (buckets or BUCKETS) if keys else 1
    folders = _write(df, path, keys, buckets)
    _commit(spark, path, held, {"keys": keys, "buckets": buckets, "schema": _joined(None, df.schema, path).json(), "folders": folders})


def _change(new: DataFrame, path: str, held: dict, touched: list[int], merged) -> None:
    """Put ``merged(old rows of the touched buckets)`` in their place."""
    spark = new.sparkSession
    schema = _joined(held["schema"], new.schema, path)
    out = merged(_folders(spark, path, held, touched))
    out = out.select(*[F.col(f"`{f.name}`") if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    folders = {b: f for b, f in held["folders"].items() if int(b) not in touched} | _write(out, path, held["keys"], held["buckets"])
    _commit(spark, path, held if held["number"] >= 0 else None, {"keys": held["keys"], "buckets": held["buckets"], "schema": schema.json(), "folders": folders})


def _staged(new: DataFrame, path: str) -> tuple[DataFrame, str]:
    """The new rows, computed once: they say which buckets are touched and are merged with these."""
    where = f"{path}/_new-{uuid.uuid4().hex}"
    new.write.parquet(where)
    return new.sparkSession.read.schema(new.schema).parquet(where), where


def upsert_store(new: DataFrame, path: str, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> None:
    """Keep-last upsert by the keys (null keys equal null keys); only buckets with new rows are written. No rows, no change.

    ``buckets`` holds for a store that this makes; one that exists keeps its own, and its keys must be these.
    """
    spark = new.sparkSession
    held = pointer(spark, path) or {"number": -1, "keys": list(keys), "buckets": buckets, "schema": _joined(None, new.schema, path).json(), "folders": {}}
    if held["keys"] != list(keys):
        raise ValueError(f"the keys of {path} are {held['keys']}")
    _joined(held["schema"], new.schema, path)
    rows, where = _staged(new, path)
    try:
        touched = [r[0] for r in rows.select(_bucket(keys, held["buckets"])).distinct().collect()]  # as many as buckets at most
        if touched:
            _change(rows, path, held, touched, lambda old: upsert(old, rows, keys, order))
    finally:
        jpath, fs = _fs(spark, where)
        fs.delete(jpath, True)


def replace_store(new: DataFrame, path: str, condition: F.Column) -> None:
    """Rows that meet the condition make room for the new ones; only buckets with either are written."""
    spark = new.sparkSession
    held = pointer(spark, path)
    if held is None:
        return publish(new, path)
    rows, where = _staged(new, path)
    try:
        at = _bucket(held["keys"], held["buckets"])
        both = _folders(spark, path, held).filter(F.coalesce(condition, F.lit(False))).select(at.alias("b")).union(rows.select(at.alias("b")))
        touched = [r[0] for r in both.distinct().collect()]
        if touched:
            _change(rows, path, held, touched, lambda old: replace_where(old, rows, condition))
    finally:
        jpath, fs = _fs(spark, where)
        fs.delete(jpath, True)


