"""Error, interval and skill metrics, metric rows and sliding windows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, is_finite

TINY = 1e-9


def pair_filter(*columns: str) -> Column:
    cond = is_finite(columns[0])
    for c in columns[1:]:
        cond = cond & is_finite(c)
    return cond


def safe_corr(y: str, p: str) -> Column:
    """Pearson correlation, null under two rows or where a side hardly varies."""
    sy, sp = F.stddev_pop(y), F.stddev_pop(p)
    return F.when((F.count(F.lit(1)) >= 2) & (sy >= TINY) & (sp >= TINY), F.try_divide(F.covar_pop(y, p), sy * sp))


def error_aggregates(y: str, p: str) -> list[Column]:
    """n, mae, rmse, mbe, nmae, nrmse and corr over rows that are finite pairs; the norm is mean |y|."""
    e = col(p) - col(y)
    norm = F.when(F.avg(F.abs(col(y))) > TINY, F.avg(F.abs(col(y))))
    mae, rmse = F.avg(F.abs(e)), F.sqrt(F.avg(e * e))
    return [F.count(F.lit(1)).alias("n"), mae.alias("mae"), rmse.alias("rmse"), F.avg(e).alias("mbe"), F.try_divide(mae, norm).alias("nmae"), F.try_divide(rmse, norm).alias("nrmse"), safe_corr(y, p).alias("corr")]


def errors(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return df.filter(pair_filter(y, p)).groupBy(*keys).agg(*error_aggregates(y, p))


def intervals(df: DataFrame, keys: list[str], y: str = "y", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Coverage (inclusive) and mean width over mean |y|."""
    inside = ((col(y) >= col(lo)) & (col(y) <= col(hi))).cast("int")
    width = F.try_divide(F.avg(col(hi) - col(lo)), F.when(F.avg(F.abs(col(y))) > TINY, F.avg(F.abs(col(y)))))
    return df.filter(pair_filter(y, lo, hi)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("picp"), width.alias("mpiw"))


def r2(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """1 - SSE / SST, and the squared correlation."""
    e = col(p) - col(y)
    return df.filter(pair_filter(y, p)).groupBy(*keys).agg((F.lit(1.0) - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0)))).alias("r2"), F.pow(safe_corr(y, p), 2).alias("corr2"))


def rolling(df: DataFrame, keys: list[str], ts: str = "ts", y: str = "y", p: str = "p", window_hours: int = 48, step_hours: int = 24) -> DataFrame:
    """Metrics in windows [t, t + window) from the first finite pair, a step apart; windows with few rows are left out.

    Each row computes the windows that hold it from its distance to the start, so no range join is needed.
    """
    pairs = df.filter(pair_filter(y, p))
    edge = pairs.groupBy(*keys).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"), F.count(F.lit(1)).alias("_all")).filter("_all >= 3")
    hours = F.lit(3600)
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    joined = pairs.join(edge, keys).withColumn("_s", sec(ts) - sec("_t0"))
    last = F.floor((sec("_t1") - sec("_t0") + hours - window_hours * 3600) / (step_hours * 3600))
    hi = F.least(F.floor(F.col("_s") / (step_hours * 3600)), last)
    lo = F.greatest(F.floor((F.col("_s") - window_hours * 3600) / (step_hours * 3600)) + 1, F.lit(0))
    placed = joined.filter(hi >= lo).withColumn("_w", F.explode(F.sequence(lo, hi)))
    out = placed.groupBy(*keys, (F.col("_t0") + F.make_dt_interval(hours=(F.col("_w") * step_hours).cast("int"))).alias("window_start")).agg(*error_aggregates(y, p))
    return out.filter(F.col("n") >= max(3, window_hours // 4))


def metric_rows(df: DataFrame, keys: list[str], y_cf: str = "y_cf", p_cf: str = "pred_cf", cap: str = "cap_mw", y_mw: str = "y_mw") -> DataFrame:
    """One row per key and scale: capacity factor, and MW (prediction times capacity)."""
    scales = F.array(F.struct(F.lit("cf").alias("scale"), col(y_cf).alias("y"), col(p_cf).alias("p")), F.struct(F.lit("mw").alias("scale"), col(y_mw).alias("y"), (col(p_cf) * col(cap)).alias("p")))
    return errors(df.select(*keys, F.explode(scales).alias("_x")).select(*keys, "_x.*"), [*keys, "scale"])


def skill(df: DataFrame, keys: list[str], model: str, baseline: str, value: str = "nmae") -> DataFrame:
    """1 - value / the baseline model's value, by key."""
    base = df.filter(F.col(model) == baseline).select(*keys, F.col(value).alias("_base"))
    return df.filter(F.col(model) != baseline).join(base, keys, "left").withColumn("skill", F.lit(1.0) - F.try_divide(F.col(value), F.col("_base"))).drop("_base")
