"""Validation of downscaled forecasts against municipal telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import lag_by_rows, prefix_split
from .calibrate import apply_affine, apply_conformal, fit_affine, fit_conformal
from .metrics import errors, intervals

KEYS = ["region", "model", "technology"]


def calibrate_and_score(df: DataFrame, keys: list[str] = KEYS, ts: str = "ts", share: float = 0.4, lag: int = 24) -> tuple[DataFrame, DataFrame]:
    """(calibration, metrics) of rows (keys, ts, y, base): fitted on the first share of each series by time, scored on the rest.

    Hours without telemetry count towards the share. Variants: the raw base, the calibrated one, and the value ``lag`` rows ago.
    """
    rows = prefix_split(lag_by_rows(df, keys, ts, "y", lag, "_back"), keys, ts, share)
    fitted = fit_affine(rows.filter("fit"), keys)
    test = rows.filter("NOT fit").join(fitted.drop("n"), keys)
    kinds = F.explode(F.array(F.struct(F.lit("raw").alias("variant"), F.col("base").alias("p")), F.struct(F.lit("calibrated").alias("variant"), apply_affine("base").alias("p")), F.struct(F.lit("persistence").alias("variant"), F.col("_back").alias("p"))))
    long = test.withColumn("_v", kinds).select(*keys, "y", "_v.variant", "_v.p")
    return fitted, errors(long, [*keys, "variant"])


def interval_score(df: DataFrame, keys: list[str] = KEYS, ts: str = "ts", share: float = 0.4, alpha: float = 0.2) -> DataFrame:
    """Coverage and width of calibrated bounds (y, base, lo, hi) before and after the conformal correction, on the held-out rows."""
    rows = prefix_split(df, keys, ts, share)
    affine = fit_affine(rows.filter("fit"), keys).drop("n")
    scaled = rows.join(affine, keys).withColumns({"lo": apply_affine("lo"), "hi": apply_affine("hi")})
    cal = fit_conformal(scaled.filter("fit"), keys, alpha=alpha).select(*keys, "q", "w_floor")
    test = scaled.filter("NOT fit").join(cal, keys)
    lo, hi = apply_conformal("lo", "hi")
    before = intervals(test, keys).withColumnsRenamed({"picp": "picp_before", "mpiw": "mpiw_before"})
    after = intervals(test.withColumns({"_lo": lo, "_hi": hi}).drop("lo", "hi").withColumnsRenamed({"_lo": "lo", "_hi": "hi"}), keys).withColumnsRenamed({"picp": "picp_after", "mpiw": "mpiw_after"}).drop("n")
    return before.join(after, keys)
