"""Affine downscaling, split conformal intervals and transfer between sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clip
from .metrics import TINY, error_aggregates, pair_filter

#: Floors of the half-width, as shares of the mean half-width (fixed values).
FLOORS = (0.001, 0.01, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 64.0, 256.0, 1024.0)


def fit_affine(df: DataFrame, keys: list[str], y: str = "y", base: str = "base") -> DataFrame:
    """(scale, offset, n) of y = scale * base + offset by least squares.

    Under two pairs, a constant base or a slope that is not positive: scale 1 and the mean difference.
    """
    pairs = df.filter(pair_filter(y, base))
    agg = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y) - F.col(base)).alias("_d"), F.regr_slope(y, base).alias("_a"), F.regr_intercept(y, base).alias("_b"), F.stddev_pop(base).alias("_s"))
    good = (F.col("n") >= 2) & (F.col("_s") >= TINY) & F.coalesce(F.col("_a") > 0, F.lit(False))
    return agg.select(*keys, F.when(good, F.col("_a")).otherwise(1.0).alias("scale"), F.when(good, F.col("_b")).otherwise(F.col("_d")).alias("offset"), "n")


def apply_affine(base: Column | str, scale: Column | str = "scale", offset: Column | str = "offset") -> Column:
    """max(scale * base + offset, 0); null propagates."""
    x = (F.col(scale) if isinstance(scale, str) else scale) * (F.col(base) if isinstance(base, str) else base) + (F.col(offset) if isinstance(offset, str) else offset)
    return clip(x, 0.0)


def pooled_scale(calibration: DataFrame, keys: list[str]) -> DataFrame:
    """Mean scale over the pilots, 1 without any; pooled use has no offset."""
    return calibration.groupBy(*keys).agg(F.coalesce(F.avg("scale"), F.lit(1.0)).alias("scale"), F.lit(0.0).alias("offset"))


#: Bins of scores for each factor of e, and the score from which on they are that fine.
FINE, SMALLEST = 1000.0, 0.01


def _bin(score: Column) -> Column:
    """The bin of a score; never falls as scores grow."""
    size = F.floor(F.log1p(F.abs(score) / SMALLEST) * FINE)
    return F.when(score < 0, -1 - size).otherwise(size)


def fit_conformal(df: DataFrame, keys: list[str], y: str = "y", lo: str = "lo", hi: str = "hi", alpha: float = 0.2) -> DataFrame:
    """(q, w_floor, width, n): width-normalised split-conformal correction with the narrowest of the floors.

    The quantile is the order statistic at ceil(level * (n - 1)), counted from 0. Rows that agree are written once with their number, and read three times: the scores of
    every floor are counted in fixed bins; distinct scores in the bin that holds the rank are counted and ordered (a thousandth of a group's, as bins
    are narrow), so a hot group is never sorted; and interval widths decide between floors, rounded, the first winning ties: once a
    floor exceeds every half-width all larger ones give the same interval. Under two rows or without width: (0, 0).
    """
    from .checkpoint import cut

    pairs = df.filter(pair_filter(y, lo, hi)).select(*keys, F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi)).alias("_miss"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), ((F.col(hi) - F.col(lo)) / 2).alias("_half"))
    alike = cut(pairs.groupBy(*keys, "_miss", "_lo", "_hi", "_half").agg(F.count(F.lit(1)).alias("_k")))
    size = cut(alike.groupBy(*keys).agg(F.sum("_k").alias("n"), (F.sum(F.col("_half") * F.col("_k")) / F.sum("_k")).alias("_mean")))
    rows = alike.join(size.filter("n >= 2 AND _mean > 0").drop("n"), keys)
    w = [F.greatest("_half", F.lit(f) * F.col("_mean")) for f in FLOORS]
    scores = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("_miss") / x).alias("e")) for i, x in enumerate(w)])
    by_bin = rows.select(*keys, "_k", F.explode(scores).alias("_s")).groupBy(*keys, "_s.i", _bin(F.col("_s.e")).alias("_bin")).agg(F.sum("_k").alias("_c"))
    level = F.least(F.ceil((F.col("n") + 1) * F.lit(1 - alpha)) / F.col("n"), F.lit(1.0))
    upto = by_bin.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "i").orderBy("_bin"))).join(size, keys).withColumn("_at", F.ceil(level * (F.col("n") - 1)))
    goal = cut(upto.filter("_at < _upto AND _at >= _upto - _c").select(*keys, "i", "_bin", (F.col("_at") - F.col("_upto") + F.col("_c")).alias("_rank")))
    goals = goal.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "_bin"))).alias("_goals"))  # an entry for each floor
    near = F.filter(scores, lambda x: _bin(x["e"]) == F.col("_goals")[x["i"]])
    band = rows.join(goals, keys).select(*keys, "_k", F.explode(near).alias("_s")).groupBy(*keys, "_s.i", "_s.e").agg(F.sum("_k").alias("_c"))
    place = band.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "i").orderBy("e"))).join(goal.select(*keys, "i", "_rank"), [*keys, "i"])
    found = place.filter("_rank < _upto AND _rank >= _upto - _c")
    q = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "e"))).alias("_q"))
    own = [F.col("_q")[F.lit(i)] for i in range(len(FLOORS))]
    width = rows.join(q, keys).groupBy(*keys).agg(F.first("_q").alias("_q"), F.array(*[F.sum((F.col("_hi") + own[i] * x - F.greatest(F.col("_lo") - own[i] * x, F.lit(0.0))) * F.col("_k")) / F.sum("_k") for i, x in enumerate(w)]).alias("_widths"))
    each = F.array(*[F.struct(F.round(F.col("_widths")[i], 6).alias("r"), F.lit(i).alias("i"), own[i].alias("q"), F.lit(f).alias("f"), F.col("_widths")[i].alias("width")) for i, f in enumerate(FLOORS)])
    out = size.join(width.select(*keys, F.array_min(each).alias("b")), keys, "left")
    return out.select(*keys, F.coalesce("b.q", F.lit(0.0)).alias("q"), F.coalesce(F.col("b.f") * F.col("_mean"), F.lit(0.0)).alias("w_floor"), F.coalesce(F.col("b.width"), F.col("_mean") * 2).alias("width"), "n")


def apply_conformal(lo: str, hi: str, q: str = "q", w_floor: str = "w_floor") -> tuple[Column, Column]:
    """The corrected bounds; only the lower has a floor of 0."""
    w = F.greatest((F.col(hi) - F.col(lo)) / 2, F.col(w_floor))
    return clip(F.col(lo) - F.col(q) * w, 0.0), F.col(hi) + F.col(q) * w


def sequential_conformal(df: DataFrame, keys: list[str], fold: str = "fold", alpha: float = 0.2) -> DataFrame:
    """Fit on each fold, evaluate on the next that exists: coverage and width before and after."""
    fitted = fit_conformal(df, [*keys, fold], alpha=alpha).drop("n", "width")
    following = df.select(*keys, fold).distinct().withColumn("_next", F.lead(fold).over(Window.partitionBy(*keys).orderBy(fold))).filter("_next IS NOT NULL")
    cal = fitted.join(following, [*keys, fold]).select(*keys, F.col(fold).alias("cal_fold"), F.col("_next").alias(fold), "q", "w_floor")
    rows = df.filter(pair_filter("y", "lo", "hi")).join(cal, [*keys, fold])
    new_lo, new_hi = apply_conformal("lo", "hi")
    rows = rows.withColumns({"_lo": new_lo, "_hi": new_hi})
    inside = lambda a, b: F.avg(((F.col("y") >= F.col(a)) & (F.col("y") <= F.col(b))).cast("int"))
    norm = F.when(F.avg(F.abs("y")) > TINY, F.avg(F.abs("y")))
    return rows.groupBy(*keys, fold, "cal_fold").agg(F.count(F.lit(1)).alias("n"), inside("lo", "hi").alias("picp_before"), inside("_lo", "_hi").alias("picp_after"), F.try_divide(F.avg(F.col("hi") - F.col("lo")), norm).alias("mpiw_before"), F.try_divide(F.avg(F.col("_hi") - F.col("_lo")), norm).alias("mpiw_after"))


def transfer(df: DataFrame, site: str = "site", y: str = "y", base: str = "base") -> DataFrame:
    """Each site's own calibration (oracle), every other site's (transferred) and none (uncalibrated) on the site's rows.

    Sites are the pilots of a study: their ordered pairs are a small table.
    """
    fitted = fit_affine(df, [site], y, base).drop("n")
    donors = fitted.select(F.col(site).alias("donor"), "scale", "offset")
    targets = fitted.select(site)
    pairs = targets.crossJoin(donors).withColumn("variant", F.when(F.col(site) == F.col("donor"), "oracle").otherwise("transferred"))
    plain = targets.select(site, F.lit(None).cast(df.schema[site].dataType).alias("donor"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit("uncalibrated").alias("variant"))
    rows = df.filter(pair_filter(y, base)).join(pairs.unionByName(plain), site)
    raw = F.col("scale") * F.col(base) + F.col("offset")
    rows = rows.withColumn("_p", apply_affine(base)).withColumn("_neg", F.coalesce(raw < 0, F.lit(False)).cast("int"))
    return rows.groupBy(site, "donor", "variant").agg(*error_aggregates(y, "_p"), F.avg("_neg").alias("clipped"))
