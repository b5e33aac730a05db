"""Purged expanding-window folds and the baselines evaluated on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_bounds(df: DataFrame, ts: str = "ts", n: int = 4, test_days: int = 365, gap_hours: int = 72) -> DataFrame:
    """(fold from 1, train_start, train_end, test_start, test_end); raises in the plan where the span is too short.

    Training is closed at both ends, testing half-open at its start.
    """
    edge = df.agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    enough = F.assert_true(F.col("t1") - F.make_dt_interval(days=F.lit(n * test_days), hours=F.lit(gap_hours)) >= F.col("t0"), F.lit("the series is too short for the folds"))
    fold = edge.filter(enough.isNull()).select("t0", "t1", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("fold"))
    end = F.col("t1") - F.make_dt_interval(days=(F.lit(n) - F.col("fold")) * test_days)
    start = end - F.make_dt_interval(days=F.lit(test_days))
    return fold.select("fold", F.col("t0").alias("train_start"), (start - F.make_dt_interval(hours=F.lit(gap_hours))).alias("train_end"), start.alias("test_start"), end.alias("test_end"))


def assign(df: DataFrame, bounds: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with (fold, role): a row trains several folds. The bounds are as many rows as folds."""
    role = F.when((F.col(ts) >= F.col("train_start")) & (F.col(ts) <= F.col("train_end")), "train").when((F.col(ts) > F.col("test_start")) & (F.col(ts) <= F.col("test_end")), "test")
    return df.crossJoin(F.broadcast(bounds)).withColumn("role", role).filter("role IS NOT NULL").drop("train_start", "train_end", "test_start", "test_end")


def summary(assigned: DataFrame, ts: str = "ts") -> DataFrame:
    return assigned.groupBy("fold", "role").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def climatology(train: DataFrame, keys: list[str], parts: list[str], value: str, name: str = "climatology") -> DataFrame:
    return train.groupBy(*keys, *parts).agg(F.avg(value).alias(name))


def climatology_predict(test: DataFrame, fitted: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Left join: combinations never seen in training predict null."""
    return test.join(fitted, [*keys, *parts], "left")
