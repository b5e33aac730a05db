"""Helpers shared by the corpus operators: table access, shared-storage checkpoints and column hygiene."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, as rows hold whole texts; smaller settings stay.

    A setting of the session: queries and pipeline stages make it, operators leave the caller's session as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local master (as in tests) takes a temporary folder of its one machine; a cluster takes a
    folder in the warehouse, which must not be a local path: nothing is ever written to one machine of a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    made = getattr(spark.sparkContext, "_gridcast_checkpoint_dir", None)
    if made is None:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            made = "file://" + tempfile.mkdtemp(prefix="gridcast-checkpoint-")
        else:
            made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
            if spark._jvm.org.apache.hadoop.fs.Path(made).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext._gridcast_checkpoint_dir = made
    return made


def _few(df: DataFrame) -> DataFrame:
    """About a task a core, and an eighth of the shuffle partitions at least: small intermediate tables in many partitions would make as many files."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are dropped when it ends, as nothing reads them again; the session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a (small, iterated) frame through reliable storage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with _tidy(spark):
        return _few(df).checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str, scan: bool = False) -> DataFrame:
    """Write a frame that several later steps read to the shared folder as Parquet, and read it back.

    ``scan``: made next to a scan, whose partitions it keeps.
    """
    path = scratch(df.sparkSession, name)
    with _tidy(df.sparkSession):
        (df if scan else _few(df)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def private(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with: names made with it clash with none."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def uniform(seed: int, *cols) -> F.Column:
    """A uniform number in [0, 1) that depends on the values only: the first 32 bits of an MD5."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


BITS = 1 << 23


def seen_bitmap(df: DataFrame, col: str) -> DataFrame:
    """A bitmap of the hashed values of ``col`` (``BITS`` bits in buckets of 4 KB: 1 MB in all, whatever the input)."""
    bit = F.pmod(F.xxhash64(col), F.lit(BITS))
    return df.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def mark_seen(df: DataFrame, bitmap: DataFrame, value: F.Column, seen: str = "_seen") -> DataFrame:
    """``df`` with the flag ``seen``: whether the bitmap may hold ``value`` (never false where it does). The bitmap is broadcast, 1 MB at most."""
    p = private(df)
    bit = F.pmod(F.xxhash64(value), F.lit(BITS))
    byte = F.conv(F.hex(F.substring(f"{p}bits", (F.col(f"{p}at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(`{p}at` % 8 as int))")) != 0
    held = F.broadcast(bitmap.select(F.col("bucket").alias(f"{p}bucket"), F.col("bits").alias(f"{p}bits")))
    joined = df.withColumns({f"{p}at": F.bitmap_bit_position(bit), f"{p}bucket": F.bitmap_bucket_number(bit)}).join(held, f"{p}bucket", "left")
    return joined.withColumn(seen, F.coalesce(hit, F.lit(False))).drop(f"{p}at", f"{p}bucket", f"{p}bits")
