"""Cutting the lineage of iterated frames through reliable, shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """``spark.checkpoint.dir``; unset, a temporary folder for a local master and a warehouse folder on a cluster, where it is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        made = getattr(spark.sparkContext, "_gridcast_shared_dir", None)
        if made is None:  # one folder for a session
            made = spark.sparkContext._gridcast_shared_dir = "file://" + tempfile.mkdtemp(prefix="gridcast-")
        return made
    found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark._jvm.org.apache.hadoop.fs.Path(found).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
