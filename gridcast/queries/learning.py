"""Learners under purged folds (no SQL counterpart)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import folds, ml, sequence
from ..plans.metrics import errors
from .common import rounded, t

FEATURES = ["prior", "level", "month_sin"]


def _matrix(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy(F.col("l_shipdate").alias("ts")).agg((F.avg("l_extendedprice") / 50000).alias("cf"), (F.avg("l_quantity") / 25).alias("prior"), F.avg("l_discount").alias("level"), F.sin(2 * F.pi() * F.month(F.first("l_shipdate")) / 12).alias("month_sin"))


def gbt_oof(spark, d):
    m = _matrix(spark, d)
    b = folds.fold_bounds(m)
    return rounded(errors(ml.cross_validate(m, b, ml.boosted(), FEATURES, "cf", "gbt"), ["model", "fold"], "y", "pred"))


def quantile_oof(spark, d):
    """Coverage and width of the boosted quantiles' band on held-out days, by fold."""
    m = _matrix(spark, d)
    oof = ml.cross_validate(m, folds.fold_bounds(m), ml.quantile_boosted(), FEATURES, "cf", "quantile")
    inside = F.avg(((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("int"))
    return rounded(oof.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), inside.alias("picp"), F.avg(F.col("hi") - F.col("lo")).alias("mpiw"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae")))


def sequence_oof(spark, d):
    m = _matrix(spark, d)
    return rounded(errors(ml.cross_validate(m, folds.fold_bounds(m), ml.sequence(ml.linear(0.01), 24), FEATURES, "cf", "sequence"), ["model", "fold"], "y", "pred"))


def _series(spark, d):
    # A row a day: one series of a length that no size of the tables changes.
    return _matrix(spark, d).withColumn("series", F.lit("all"))


def recurrent_oof(spark, d):
    m = _series(spark, d)
    return rounded(errors(ml.cross_validate(m, folds.fold_bounds(m), sequence.recurrent(keys=("series",)), FEATURES, "cf", "recurrent"), ["model", "fold"], "y", "pred"))


def attentive_oof(spark, d):
    """Errors of the last of 24 steps ahead."""
    m = _series(spark, d)
    return rounded(errors(ml.cross_validate(m, folds.fold_bounds(m), sequence.attentive(keys=("series",)), FEATURES, "cf", "attentive"), ["model", "fold"], "y", "pred"))


def attentive_weights(spark, d):
    """What the network looks at in the last fold: mean attention by lag, and mean weights of past and known variables."""
    m = _series(spark, d)
    own = folds.assign(m, folds.fold_bounds(m, n=1))
    model = sequence.attentive(keys=("series",))(own.filter("role = 'train'"), FEATURES, "cf")
    return rounded(model.weights(own.filter("role = 'test'")).groupBy("kind", "name").agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("n")))


def row_attribution(spark, d):
    """Shapley values of the boosted median, which add up to its prediction less the base."""
    m = _matrix(spark, d)
    rows = ml.quantile_boosted((0.5,))(m, FEATURES, "cf").attribute(m)
    return rounded(rows.select("ts", "base", "pred", *[f"by_{f}" for f in FEATURES]))


def feature_effects(spark, d):
    """How far a linear model's predictions fall where a feature is at its mean: mean absolute fall by feature."""
    m = _matrix(spark, d)
    rows = ml.attribution(m, ml.linear()(m, FEATURES, "cf"), FEATURES)
    return rounded(rows.agg(*[F.avg(F.abs(f"by_{f}")).alias(f) for f in FEATURES]))


def additive_importance(spark, d):
    m = _matrix(spark, d)
    return rounded(ml.additive(pairs=1)(m, FEATURES, "cf").importance(m))


def additive_oof(spark, d):
    m = _matrix(spark, d)
    b = folds.fold_bounds(m)
    return rounded(errors(ml.cross_validate(m, b, ml.additive(pairs=1), FEATURES, "cf", "additive"), ["model", "fold"], "y", "pred"))


def quantile_bands(spark, d):
    m = _matrix(spark, d)
    own = folds.assign(m, folds.fold_bounds(m, n=1))
    train = own.filter("role = 'train'")
    band = ml.quantile_band(train, ml.linear()(train, FEATURES, "cf"), "cf")
    return rounded(band(own.filter("role = 'test'")).select("ts", "cf", "lo", "pred", "hi"))


def feature_ablation(spark, d):
    m = _matrix(spark, d)
    return rounded(ml.ablation(m, folds.fold_bounds(m), ml.linear(), FEATURES, ["prior"], "cf", "linear"))


def weather_input_gap(spark, d):
    m = _matrix(spark, d)
    noisy = m.withColumn("prior", F.col("prior") * (F.lit(1.0) + (F.day("ts") % 5 - 2) * 0.05))
    return rounded(ml.input_gap(m, noisy, folds.fold_bounds(m), ml.linear(), FEATURES, "cf"))


def feature_importance(spark, d):
    m = _matrix(spark, d)
    return rounded(ml.permutation_importance(m, ml.linear()(m, FEATURES, "cf"), FEATURES, "cf"))


QUERIES = {f.__name__: (f, None) for f in (gbt_oof, quantile_oof, sequence_oof, recurrent_oof, attentive_oof, attentive_weights, row_attribution, feature_effects, additive_oof, additive_importance, quantile_bands, feature_ablation, weather_input_gap, feature_importance)}
