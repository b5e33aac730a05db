"""Paired comparisons of forecasts: Diebold-Mariano, moving-block bootstrap and sign tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def student_p(t: float | None, df: int | None) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or df < 1:
        return None
    return _beta_tail(df / (df + t * t), df / 2, 0.5)


def sign_p(wins: int | None, n: int | None) -> float | None:
    """Two-sided exact binomial test at one half."""
    if not n:
        return None
    pmf = [math.comb(n, k) * 0.5**n for k in range(n + 1)]
    return min(1.0, sum(p for p in pmf if p <= pmf[wins] * (1 + 1e-7)))


def diebold_mariano(df: DataFrame, keys: list[str], ts: str = "ts", a: str = "err_a", b: str = "err_b", p_value: bool = True) -> DataFrame:
    """(n, stat, p) of d = |a| - |b| with a Newey-West variance of floor(cbrt(n)) lags; null under 10 rows or without variance.

    The lagged products come from a self-join on the row number; each lag's mean is over its own n - k products.
    """
    d = df.select(*keys, ts, (F.abs(a) - F.abs(b)).alias("_d")).filter("_d IS NOT NULL AND NOT isnan(_d)")
    size = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("_mean"))
    row = d.join(size, keys).withColumn("_c", F.col("_d") - F.col("_mean")).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)))
    lags = F.floor(F.pow(F.col("n").cast("double"), F.lit(1.0 / 3)) + 1e-9).cast("int")
    left = row.withColumn("_l", lags).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_l")))).select(*keys, "n", "_mean", "_l", "_k", (F.col("_rn") - F.col("_k")).alias("_rn"), F.col("_c").alias("_x"))
    prod = left.join(row.select(*keys, "_rn", F.col("_c").alias("_y")), [*keys, "_rn"])
    gamma = prod.groupBy(*keys, "n", "_mean", "_l", "_k").agg(F.avg(F.col("_x") * F.col("_y")).alias("_g"))
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(F.lit(2.0) * (F.lit(1.0) - F.col("_k") / (F.col("_l") + 1)))
    out = gamma.groupBy(*keys, "n", "_mean").agg(F.sum(weight * F.col("_g")).alias("_s"))
    stat = F.when((F.col("n") >= 10) & (F.col("_s") > 0), F.col("_mean") / F.sqrt(F.col("_s") / F.col("n")))
    out = out.withColumn("stat", stat).select(*keys, "n", "stat")
    if not p_value:
        return out

    @F.udf(T.DoubleType())
    def tail(t, n):  # one row for each pair of models
        return student_p(t, None if n is None else n - 1)

    return out.withColumn("p", tail("stat", "n"))


def block_bootstrap(df: DataFrame, keys: list[str], ts: str = "ts", y: str = "y", a: str = "err_a", b: str = "err_b", block: int = 168, reps: int = 2000, seed: int = 0) -> DataFrame:
    """(n, point, lo, hi) of the difference in normalised MAE, by moving blocks.

    With prefix sums a block is two lookups. Block starts are hashes of (seed, replicate, block), so they need no driver and agree
    for all pairs of models of a length. Null under two blocks.
    """
    rows = df.select(*keys, ts, F.abs(a).alias("_a"), F.abs(b).alias("_b"), F.abs(y).alias("_y")).dropna()
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    pre = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ts))).select(*keys, "_rn", *[F.sum(c).over(w).alias(c) for c in ("_a", "_b", "_y")])
    zero = pre.select(*keys).distinct().select(*keys, F.lit(0).alias("_rn"), *[F.lit(0.0).alias(c) for c in ("_a", "_b", "_y")])
    pre = pre.unionByName(zero)
    size = pre.groupBy(*keys).agg(F.max("_rn").alias("n"), F.max_by(F.struct("_a", "_b", "_y"), "_rn").alias("_all"))
    count = F.ceil(F.col("n") / block).cast("int")
    draw = size.filter(F.col("n") >= 2 * block).withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_j", F.explode(F.sequence(F.lit(1), count)))
    start = F.pmod(F.xxhash64(F.lit(seed), "_rep", "_j"), (F.col("n") - block + 1).cast("long"))
    length = F.when(F.col("_j") == count, F.col("n") - (count - 1) * block).otherwise(block)
    draw = draw.withColumns({"_s": start, "_e": start + length})
    at = lambda name, col: pre.select(*keys, F.col("_rn").cast("long").alias(col), *[F.col(c).alias(name + c) for c in ("_a", "_b", "_y")])
    both = draw.join(at("s", "_s"), [*keys, "_s"]).join(at("e", "_e"), [*keys, "_e"])
    rep = both.groupBy(*keys, "_rep").agg(*[F.sum(F.col("e" + c) - F.col("s" + c)).alias(c) for c in ("_a", "_b", "_y")])
    stat = rep.withColumn("_v", F.try_divide(F.col("_a") - F.col("_b"), F.col("_y")))
    ci = stat.groupBy(*keys).agg(F.percentile("_v", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    point = F.try_divide(F.col("_all._a") - F.col("_all._b"), F.col("_all._y"))
    return size.join(ci, keys, "left").select(*keys, "n", point.alias("point"), F.col("_ci")[0].alias("lo"), F.col("_ci")[1].alias("hi"))


def model_pairs(errors: DataFrame, keys: list[str], ts: str = "ts", model: str = "model", err: str = "err") -> DataFrame:
    """All unordered model pairs on their common hours: (keys, model_a, model_b, ts, err_a, err_b)."""
    a = errors.select(*keys, ts, F.col(model).alias("model_a"), F.col(err).alias("err_a"))
    b = errors.select(*keys, ts, F.col(model).alias("model_b"), F.col(err).alias("err_b"))
    return a.join(b, [*keys, ts]).filter("model_a < model_b")


def compare_models(oof: DataFrame, keys: list[str], ts: str = "ts", model: str = "model", y: str = "y", pred: str = "pred", block: int = 168, reps: int = 2000, seed: int = 0) -> DataFrame:
    """All pairs of models of out-of-fold rows on their common hours: hours, gap of the normalised MAE with its bootstrap interval, Diebold-Mariano and its p."""
    rows = oof.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()).withColumn("err", F.col(pred) - F.col(y))
    truth = rows.groupBy(*keys, ts).agg(F.first(y).alias("y"))
    pairs = model_pairs(rows, keys, ts, model).join(truth, [*keys, ts])
    own = [*keys, "model_a", "model_b"]
    gap = block_bootstrap(pairs, own, ts, "y", block=block, reps=reps, seed=seed).withColumnsRenamed({"n": "n_hours", "point": "gap", "lo": "gap_lo", "hi": "gap_hi"})
    return gap.join(diebold_mariano(pairs, own, ts).drop("n").withColumnsRenamed({"stat": "dm", "p": "dm_p"}), own, "left")


def fold_summary(metrics: DataFrame, keys: list[str], model_a: str, model_b: str, fold: str = "fold", value: str = "nmae") -> DataFrame:
    """Per key over folds: gap statistics, wins of the first model, folds decided, and the sign test."""
    wide = metrics.groupBy(*keys, fold).agg(F.max(F.when(F.col("model") == model_a, F.col(value))).alias("_a"), F.max(F.when(F.col("model") == model_b, F.col(value))).alias("_b")).dropna(subset=["_a", "_b"])
    gap = F.col("_a") - F.col("_b")
    out = wide.groupBy(*keys).agg(F.avg(gap).alias("gap_mean"), F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"), F.count_if(gap < 0).alias("wins"), F.count_if(gap != 0).alias("decided"))

    @F.udf(T.DoubleType())
    def test(wins, n):  # one row a pair
        return sign_p(wins, n)

    return out.withColumn("sign_p", test("wins", "decided"))

