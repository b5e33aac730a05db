"""Streaming telemetry: deduplication within a watermark, tumbling, sliding and session windows, joins, state and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..plans.metrics import error_aggregates
from ..sources.stores import upsert_store


def prepared(df: DataFrame, ts: str = "ts", late: str = "2 hours", keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Event time as an instant, a watermark, and one row for each key and time within it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def tumbling(df: DataFrame, keys: list[str], values: list[str], ts: str = "ts", width: str = "1 hour") -> DataFrame:
    return df.groupBy(*keys, F.window(ts, width)).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("window_start"), *values, "n")


def sliding_errors(df: DataFrame, keys: list[str], ts: str = "ts", width: str = "48 hours", step: str = "24 hours", y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*keys, F.window(ts, width, step)).agg(*error_aggregates(y, p)).select(*keys, F.col("window.start").alias("window_start"), "n", "mae", "rmse", "mbe", "nmae")


def gap_sessions(df: DataFrame, keys: list[str], ts: str = "ts", gap: str = "45 minutes") -> DataFrame:
    return df.groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def with_forecast(measured: DataFrame, forecast: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Stream joined to a static (or watermarked) forecast on key and time."""
    return measured.join(forecast, [*keys, ts])


class RunningMaximum(StatefulProcessor):
    """The running maximum of each key, kept over batches; null values give null and leave it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("top", "top double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        top = self.state.get()[0] if self.state.exists() else None
        for frame in rows:
            frame = frame.sort_values("ts")
            out = []
            for v in frame["value"]:
                if pd.isna(v):
                    out.append(None)
                    continue
                top = v if top is None else max(top, v)
                out.append(top)
            yield pd.DataFrame({"key": [key[0]] * len(frame), "ts": frame["ts"], "top": pd.Series(out, dtype=float)})
        if top is not None:
            self.state.update((float(top),))

    def close(self) -> None:
        pass


def running_maximum(df: DataFrame, key: str, ts: str = "ts", value: str = "value") -> DataFrame:
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(RunningMaximum(), "key string, ts timestamp, top double", "Append", "None")


def upsert_stream(df: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None) -> DataStreamWriter:
    """Each micro-batch becomes a keep-last upsert of the store; a batch that is run again leaves the same table."""
    return df.writeStream.foreachBatch(lambda batch, _: upsert_store(batch, path, keys, order)).option("checkpointLocation", checkpoint).outputMode("append")


def append_stream(df: DataFrame, path: str, checkpoint: str, every: str = "15 minutes") -> DataStreamWriter:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every)
