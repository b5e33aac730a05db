"""Naive forecasts under the folds: the value a day (or any interval) ago, and climatology fitted on each fold's training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import lag_by_time
from .folds import assign, climatology, climatology_predict
from .metrics import errors


def persistence(df: DataFrame, bounds: DataFrame, keys: list[str], ts: str, value: str, interval: str = "24 HOUR") -> DataFrame:
    """(keys, fold, ts, y, p) on test rows; the lag is taken over the whole series by label."""
    lagged = lag_by_time(df.select(*keys, ts, value), keys, ts, value, interval, "p")
    return assign(lagged, bounds, ts).filter("role = 'test'").select(*keys, "fold", ts, F.col(value).alias("y"), "p")


def climatology_forecast(df: DataFrame, bounds: DataFrame, keys: list[str], ts: str, value: str, parts: dict[str, Column]) -> DataFrame:
    """(keys, fold, ts, y, p): means by calendar parts of each fold's training rows; parts never seen predict null."""
    rows = assign(df.select(*keys, ts, value).withColumns(parts), bounds, ts)
    fitted = climatology(rows.filter("role = 'train'"), [*keys, "fold"], list(parts), value, "p")
    test = climatology_predict(rows.filter("role = 'test'"), fitted, [*keys, "fold"], list(parts))
    return test.select(*keys, "fold", ts, F.col(value).alias("y"), "p")


def baseline_metrics(df: DataFrame, bounds: DataFrame, keys: list[str], ts: str, value: str, parts: dict[str, Column], interval: str = "24 HOUR") -> DataFrame:
    both = persistence(df, bounds, keys, ts, value, interval).withColumn("model", F.lit("persistence")).unionByName(climatology_forecast(df, bounds, keys, ts, value, parts).withColumn("model", F.lit("climatology")))
    return errors(both, ["model", *keys, "fold"])
