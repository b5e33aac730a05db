"""Day-ahead forecasts by district, their state aggregate, and queries over issued runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hour_ceil
from .calibrate import apply_affine, apply_conformal
from .metrics import errors


def horizon(df: DataFrame, keys: list[str], ts: str, now: Column, hours: int = 24) -> DataFrame:
    """The first ``hours`` rows of each key from the next full hour on."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.filter(F.col(ts) >= hour_ceil(now)).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= hours).drop("_rn")


def downscale(df: DataFrame, cap_mw: str = "cap_mw") -> DataFrame:
    """Three capacity-factor quantiles (q10, q50, q90) to MW: sorted, calibrated, corrected where there is a q, straddling the median.

    Uses scale, offset and, if present, conformal_q and conformal_floor. A q of zero or null leaves the band as it is.
    """
    q = F.array_sort(F.array("q10", "q50", "q90"))
    kw = df.withColumns({f"_{n}": apply_affine(q[i] * F.col(cap_mw) * 1000.0) for i, n in enumerate(("lo", "md", "hi"))})
    if "conformal_q" in df.columns:
        lo, hi = apply_conformal("_lo", "_hi", "conformal_q", "conformal_floor")
        on = F.coalesce(F.col("conformal_q") != 0, F.lit(False))
        kw = kw.withColumns({"_nlo": F.when(on, F.least(lo, "_md")).otherwise(F.col("_lo")), "_nhi": F.when(on, F.greatest(hi, "_md")).otherwise(F.col("_hi"))}).drop("_lo", "_hi").withColumnsRenamed({"_nlo": "_lo", "_nhi": "_hi"})
    return kw.select(*df.columns, (F.col("_lo") / 1000).alias("lower_mw"), (F.col("_md") / 1000).alias("median_mw"), (F.col("_hi") / 1000).alias("upper_mw"))


def state_total(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """Sums over districts by hour (bands move together)."""
    return df.groupBy(ts).agg(*[F.sum(c).alias(c) for c in columns])


def energy(df: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Energy (MWh of hourly MW) and peak of the sum of the parts."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.groupBy(*keys).agg(F.sum(total).alias("energy_mwh"), F.max(total).alias("peak_mw"))


def complete(df: DataFrame, registry: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """``df`` if every registered key has ``hours`` rows without nulls; otherwise the plan raises and names one."""
    count = df.dropna().groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bad = registry.select(key).distinct().join(count, key, "left").filter(F.coalesce("_n", F.lit(0)) != hours)
    found = bad.agg(F.count(F.lit(1)).alias("_bad"), F.min(key).alias("_key"))
    message = F.concat(F.lit("incomplete forecast: "), F.col("_key").cast("string"))
    return df.crossJoin(F.broadcast(found)).filter(F.assert_true(F.col("_bad") == 0, message).isNull()).drop("_bad", "_key")


def freshness(issued: DataFrame, keys: list[str], issued_at: str, now: Column, max_age_hours: int = 6) -> DataFrame:
    """The last run of each key, its age in hours and whether it is fresh."""
    last = issued.groupBy(*keys).agg(F.max(issued_at).alias("last_run"))
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_run").cast("timestamp"))) / 3600.0
    return last.withColumn("age_hours", age).withColumn("fresh", F.col("age_hours") <= max_age_hours)


def lead_time_errors(runs: DataFrame, actuals: DataFrame, ts: str = "ts", issued_at: str = "issued_at", bucket: int = 6) -> DataFrame:
    """Errors by lead time in buckets of hours; runs: ts, issued_at, p; actuals: ts, y."""
    lead = ((F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col(issued_at).cast("timestamp"))) / 3600).cast("long")
    rows = runs.join(actuals, ts).withColumn("lead_hours", F.floor(lead / bucket) * bucket)
    return errors(rows, ["lead_hours"])


def envelope(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """One JSON document for each key, hours in order; a key's hours are those of one run."""
    return df.groupBy(*keys).agg(F.to_json(F.struct(*keys, F.array_sort(F.collect_list(F.struct(ts, *columns))).alias("hours"))).alias("json"))
