"""Ordered operators: spines, resampling, gaps, lags, trailing capacity, sequences and local time.

Every positional rule has an explicit order, and every window is partitioned by series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import col


def spine(df: DataFrame, keys: list[str], ts: str, step: str) -> DataFrame:
    """Every step between the first and the last timestamp of each series."""
    return df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")).select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias(ts))


def resample_mean(df: DataFrame, keys: list[str], ts: str, values: list[str], step: str = "1 hour") -> DataFrame:
    """Left-closed means by step; steps without rows between the first and the last are there as null."""
    binned = df.groupBy(*keys, F.window(ts, step)["start"].alias(ts)).agg(*[F.avg(v).alias(v) for v in values])
    return spine(binned, keys, ts, step).join(binned, [*keys, ts], "left")


def lag_by_time(df: DataFrame, keys: list[str], ts: str, value: str, interval: str = "24 HOUR", name: str = "lagged") -> DataFrame:
    """The value exactly ``interval`` earlier by label, null over gaps."""
    back = df.select(*keys, (F.col(ts) + F.expr(f"INTERVAL {interval}")).alias(ts), F.col(value).alias(name))
    return df.join(back, [*keys, ts], "left")


def lag_by_rows(df: DataFrame, keys: list[str], ts: str, value: str, n: int = 24, name: str = "lagged") -> DataFrame:
    """The value ``n`` rows earlier, whatever the gaps."""
    return df.withColumn(name, F.lag(value, n).over(Window.partitionBy(*keys).orderBy(ts)))


def interpolate_gaps(df: DataFrame, keys: list[str], ts: str, value: str, max_gap: int = 3) -> DataFrame:
    """Runs of at most ``max_gap`` nulls between values are filled linearly by position; longer and outer runs stay null."""
    w = Window.partitionBy(*keys).orderBy(ts)
    island = df.withColumn("_g", F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = Window.partitionBy(*keys).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
    own = Window.partitionBy(*keys, "_g")
    step = island.withColumns({
        "_prev": F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.first(value, ignorenulls=True).over(after),
        "_len": F.count(F.lit(1)).over(own) - 1,
        "_k": F.row_number().over(own.orderBy(ts)) - 1,
    })
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when((F.col("_g") > 0) & F.col("_next").isNotNull() & (F.col("_len") <= max_gap), F.col("_prev") + (F.col("_next") - F.col("_prev")) * F.col("_k") / (F.col("_len") + 1))
    return step.withColumn(value, filled).drop("_g", "_prev", "_next", "_len", "_k")


def cumulative_max(value: Column | str, keys: list[str], ts: str) -> Column:
    """Running maximum that is null where the value is."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(col(value).isNotNull(), F.max(value).over(w))


def _trailing(frame: pd.DataFrame, ts: str, value: str, span: np.timedelta64, q: float, least: int) -> np.ndarray:
    """Linear-interpolated quantile over (t - span, t] of non-null values, null under ``least`` of them."""
    out = pd.Series(frame[value].to_numpy(float), index=pd.DatetimeIndex(frame[ts])).rolling(pd.Timedelta(span), min_periods=least, closed="right").quantile(q)
    return out.to_numpy()


def trailing_quantile(df: DataFrame, keys: list[str], ts: str, value: str, days: int = 365, q: float = 0.999, least: int = 720, name: str = "trailing") -> DataFrame:
    """Trailing quantile over (t - days, t], by Arrow groups of a series' stretch.

    A SQL range window recomputes each frame's percentile (quadratic in its rows); a rolling order statistic is linear times a
    logarithm. A series is cut into stretches of twice the window; each is one group and gets the window before it as context, so
    a group's size is that of three windows, however long the series, and one series is many tasks.
    """
    stretch = 2 * (days + 1)
    day = F.datediff(F.to_date(F.col(ts)), F.lit("1970-01-01").cast("date"))
    own = F.floor(day / stretch)
    late = day - own * stretch >= stretch - days - 1
    rows = df.withColumn("_own", own).withColumn("_stretch", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    rows = rows.withColumn("_own", F.col("_own").eqNullSafe(F.col("_stretch")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts)
        frame[name] = _trailing(frame, ts, value, np.timedelta64(days, "D"), q, least)
        return frame[frame["_own"].astype(bool)].drop(columns=["_own", "_stretch"]).astype({name: float})

    fields = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    out = rows.groupBy(*keys, "_stretch").applyInPandas(run, f"{fields}, {name} double")
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def effective_capacity(df: DataFrame, keys: list[str], ts: str, value: str, days: int = 365, q: float = 0.999, least: int = 720, name: str = "cap") -> DataFrame:
    """Trailing quantile of the past (one row back), as a running maximum: no row sees its own or a later value."""
    w = Window.partitionBy(*keys).orderBy(ts)
    back = trailing_quantile(df, keys, ts, value, days, q, least, "_q").withColumn("_l", F.lag("_q", 1).over(w))
    return back.withColumn(name, cumulative_max("_l", keys, ts)).drop("_q", "_l")


def sequence_windows(df: DataFrame, keys: list[str], ts: str, features: list[str], length: int = 24, ahead: int = 0, name: str = "window") -> DataFrame:
    """Rows with the ``length`` feature rows before them (and ``ahead`` from them on), full windows only."""
    w = Window.partitionBy(*keys).orderBy(ts)
    item = F.array(*[F.col(f).cast("double") for f in features])
    out = df.withColumn(name, F.collect_list(item).over(w.rowsBetween(-length, -1))).filter(F.size(name) == length)
    if ahead:
        out = out.withColumn(f"{name}_ahead", F.collect_list(item).over(w.rowsBetween(0, ahead - 1))).filter(F.size(f"{name}_ahead") == ahead)
    return out


def encoder_windows(df: DataFrame, keys: list[str], ts: str, past: list[str], known: list[str], back: int, ahead: int, past_name: str = "past", known_name: str = "known", value: str | None = None, goal: str = "goal") -> DataFrame:
    """Each row that ends a stretch of ``ahead`` rows with ``back`` rows before it: these rows' ``past`` columns, the stretch's ``known`` columns and its values."""
    w = Window.partitionBy(*keys).orderBy(ts)
    item = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    stretch = w.rowsBetween(1 - ahead, 0)
    made = {past_name: F.collect_list(item(past)).over(w.rowsBetween(1 - ahead - back, -ahead)), known_name: F.collect_list(item(known)).over(stretch)}
    if value:
        made[goal] = F.transform(F.collect_list(F.array(F.col(value).cast("double"))).over(stretch), lambda x: x[0])
    return df.withColumns(made).filter(F.size(past_name) == back)


def prefix_split(df: DataFrame, keys: list[str], ts: str, share: float, name: str = "fit") -> DataFrame:
    """Marks the first floor(n * share) rows of each series by time."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.row_number().over(w.orderBy(ts)) <= F.floor(F.count(F.lit(1)).over(w) * F.lit(share)))


def localize(df: DataFrame, keys: list[str], local: str, order: str, zone: str = "Europe/Berlin", name: str = "ts") -> DataFrame:
    """Local wall-clock times to UTC: the second pass through a repeated hour (by ``order``) is the later instant.

    The session must not shift wall times, so the arithmetic is on time-zone-free timestamps. Times that the spring change
    skips raise.
    """
    nth = F.row_number().over(Window.partitionBy(*keys, local).orderBy(order))
    early = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(local))
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), early)
    late = early + F.expr("INTERVAL 1 HOUR")
    twice = F.convert_timezone(F.lit("UTC"), F.lit(zone), late) == F.col(local)
    real = F.assert_true(back == F.col(local), F.concat(F.lit("no such local time: "), F.col(local).cast("string")))
    return df.withColumn("_n", nth).withColumn(name, F.when(real.isNull(), F.when((F.col("_n") > 1) & twice, late).otherwise(early))).drop("_n")


def local_grid(df: DataFrame, start: str, end: str, step: str = "15 minutes", zone: str = "Europe/Berlin", name: str = "ts") -> DataFrame:
    """UTC grid between two local wall-clock literals, both included."""
    edge = lambda x: F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(x).cast("timestamp_ntz"))
    return df.sparkSession.range(1).select(F.explode(F.sequence(edge(start), edge(end), F.expr(f"INTERVAL {step}"))).alias(name))


def busiest_window(df: DataFrame, keys: list[str], ts: str, values: list[str], rows: int = 120) -> DataFrame:
    """Per series the end of the window with the largest sum of z-scaled standard deviations."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(1 - rows, 0)
    whole = Window.partitionBy(*keys)
    dev = df
    for v in values:
        dev = dev.withColumn(f"_s_{v}", F.when(F.count(v).over(w) == rows, F.stddev_samp(v).over(w)))
    total = F.lit(0.0)
    for v in values:
        total = total + F.try_divide(F.col(f"_s_{v}") - F.avg(f"_s_{v}").over(whole), F.stddev_samp(f"_s_{v}").over(whole))
    scored = dev.withColumn("score", total).filter("score IS NOT NULL")
    return scored.groupBy(*keys).agg(F.max(F.struct(F.col("score"), F.col(ts))).alias("m")).select(*keys, F.col(f"m.{ts}").alias("window_end"), F.col("m.score").alias("score"))


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str = "45 minutes") -> DataFrame:
    """Runs of rows with no larger gap: start, end of the last row, and count."""
    return df.groupBy(*keys, F.session_window(ts, gap)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("session_window")

