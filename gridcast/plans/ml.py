"""Learners behind one interface, out-of-fold export, ablation and input-gap reports.

``spark.ml`` has no quantile loss, so ``quantile_boosted`` grows trees of its own (``trees``). ``sequence`` gives any learner the last rows
of every feature as a window. ``quantile_band`` makes bands for learners without quantiles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clip
from .additive import Additive, fit_additive
from .additive import Shape as AdditiveShape
from .folds import assign
from .gather import at_once
from .metrics import errors
from .trees import BINS, QuantileTrees, Shape, fit_quantiles

Fit = Callable[[DataFrame, list[str], str], Callable[[DataFrame], DataFrame]]


class Predictor:
    """Calls add ``pred``; ``save`` writes the model as a pipeline that ``load`` reads."""

    def __init__(self, *stages):
        self.model = PipelineModel(list(stages))

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).drop("_x")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> Predictor:
        return Predictor(*PipelineModel.load(path).stages)


def boosted(max_iter: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 42, loss: str = "squared") -> Fit:
    """Gradient-boosted trees; returns fit(train, features, target) -> predict(df) adding ``pred``."""

    def fit(train: DataFrame, features: list[str], target: str):
        asm = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
        model = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="pred", maxIter=max_iter, maxDepth=depth, stepSize=rate, seed=seed, lossType=loss).fit(asm.transform(train.dropna(subset=[target])))
        return Predictor(asm, model)

    return fit


def quantile_boosted(levels: tuple[float, ...] = (0.1, 0.5, 0.9), shape: Shape = Shape(), per_task: int = 4_000_000, per_round: int = 100) -> Fit:
    """Leaf-wise histogram boosting on the pinball loss of each level (see ``trees``); adds ``lo``, ``pred`` (the median) and ``hi``, kept in order.

    ``per_task`` rows stay in a task, as bytes; every ``per_round`` trees the model comes to the driver, from where a lost stage goes on.
    """

    def fit(train: DataFrame, features: list[str], target: str) -> QuantileTrees:
        return fit_quantiles(train, features, target, levels, shape, per_task, per_round)

    return fit


def lagged(df: DataFrame, features: list[str], steps: int, keys: list[str], ts: str) -> tuple[DataFrame, list[str]]:
    """``df`` with each feature's last ``steps`` values by row order within the keys, and the names of all; rows without a full window go."""
    order = Window.partitionBy(*keys).orderBy(ts)
    names = {f"{f}__{k}": F.lag(f, k).over(order) for f in features for k in range(1, steps)}
    full = F.row_number().over(order) >= steps
    return df.withColumns({**names, "_full": full}).filter("_full").drop("_full"), [*features, *names]


def sequence(fit: Fit, steps: int = 24, keys: tuple[str, ...] = (), ts: str = "ts") -> Fit:
    """A learner over windows of the last ``steps`` rows of every feature, scaled by the training rows' mean and population deviation.

    Without ``keys`` a series is cut into years, each its own window partition; a year's first ``steps`` - 1 rows have no window.
    """

    def windows(df: DataFrame, features: list[str], scale: dict) -> tuple[DataFrame, list[str]]:
        series = list(keys) or ["_year"]
        rows = df if keys else df.withColumn("_year", F.year(ts))
        scaled = rows.withColumns({f"_s_{f}": (F.col(f) - m) / s for f, (m, s) in scale.items()})
        return lagged(scaled, [f"_s_{f}" for f in features], steps, series, ts)

    def outer(train: DataFrame, features: list[str], target: str):
        scale = population_scaler(train, features)
        rows, names = windows(train, features, scale)
        inner = fit(rows.dropna(subset=names), names, target)

        def predict(df: DataFrame) -> DataFrame:
            got = inner(windows(df, features, scale)[0].dropna(subset=names))
            return got.drop(*names, "_year")

        return predict

    return outer


def attribution(df: DataFrame, predict, features: list[str]) -> DataFrame:
    """``df`` with ``pred`` and a column ``by_{feature}`` for each: how far the prediction falls where that feature is at its mean.

    For any learner, in one pass over the rows; trees have exact Shapley values (``QuantileTrees.attribute``).
    """
    mean = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    out = predict(df).withColumnRenamed("pred", "_pred")
    for f in features:
        other = predict(out.withColumns({"_kept": F.col(f), f: F.lit(float(mean[f] or 0.0))}))
        out = other.withColumns({f: F.col("_kept"), f"by_{f}": F.col("_pred") - F.col("pred")}).drop("_kept", "pred")
    return out.withColumnRenamed("_pred", "pred")


def linear(l2: float = 0.0) -> Fit:
    """Least squares; with lagged features the stand-in for sequence learners."""

    def fit(train: DataFrame, features: list[str], target: str):
        asm = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
        model = LinearRegression(featuresCol="_x", labelCol=target, predictionCol="pred", regParam=l2, solver="normal").fit(asm.transform(train.dropna(subset=[target])))
        return Predictor(asm, model)

    return fit


def additive(bins: int = BINS, pairs: int = 0, how: AdditiveShape = AdditiveShape(), per_task: int = 4_000_000) -> Fit:
    """An additive model by cyclic boosting (see ``additive``), with the ``pairs`` pairs of features that add most."""

    def fit(train: DataFrame, features: list[str], target: str) -> Additive:
        return fit_additive(train, features, target, replace(how, bins=bins, pairs=pairs), per_task)

    return fit


def quantile_band(train: DataFrame, predict, target: str, bins: int = 8, lo: float = 0.1, hi: float = 0.9):
    """Adds ``lo`` and ``hi``: residual quantiles of the training rows by bin of the prediction, kept in order with ``pred``."""
    fitted = predict(train)
    cuts = sorted(set(fitted.approxQuantile("pred", [i / bins for i in range(1, bins)], 0.001)))
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="pred", outputCol="_bin", handleInvalid="keep")
    width = split.transform(fitted).groupBy("_bin").agg(F.percentile(F.col(target) - F.col("pred"), F.array(F.lit(lo), F.lit(hi))).alias("_q"))

    def banded(df: DataFrame) -> DataFrame:
        rows = split.transform(predict(df)).join(F.broadcast(width), "_bin", "left")  # one row for each of `bins`
        three = F.array_sort(F.array(F.col("pred") + F.col("_q")[0], F.col("pred"), F.col("pred") + F.col("_q")[1]))
        return rows.withColumns({"lo": three[0], "pred": three[1], "hi": three[2]}).drop("_bin", "_q")

    return banded


def cross_validate(df: DataFrame, bounds: DataFrame, fit: Fit, features: list[str], target: str, model: str, ts: str = "ts", cap: str | None = None, at_a_time: int = 4) -> DataFrame:
    """Out-of-fold rows (fold, model, ts, y, pred, lo, hi) with predictions within [0, 1.5]; lo and hi are null for learners without
    quantiles. Folds are few; ``at_a_time`` of them are learned side by side."""
    rows = assign(df, bounds, ts)

    def one(fold: int) -> DataFrame:
        own = rows.filter(F.col("fold") == fold)
        predict = fit(own.filter("role = 'train'"), features, target)
        found = predict(own.filter("role = 'test'"))
        band = [(clip(c, 0.0, 1.5) if c in found.columns else F.lit(None).cast("double")).alias(c) for c in ("lo", "hi")]
        return found.select(F.lit(model).alias("model"), "fold", ts, F.col(target).alias("y"), clip("pred", 0.0, 1.5).alias("pred"), *band, *([cap] if cap else []))

    return reduce(DataFrame.unionByName, at_once([lambda fold=r["fold"]: one(fold) for r in bounds.select("fold").collect()], at_a_time))


VARIANTS = {"full": lambda f, p: f, "no_prior": lambda f, p: [c for c in f if c not in p], "prior_only": lambda f, p: [c for c in f if c in p]}


def ablation(df: DataFrame, bounds: DataFrame, fit: Fit, features: list[str], priors: list[str], target: str, model: str, ts: str = "ts") -> DataFrame:
    """Metrics of each feature variant, and of the raw prior without any learner."""
    out = None
    for name, pick in VARIANTS.items():
        own = pick(features, priors)
        if own:
            got = errors(cross_validate(df, bounds, fit, own, target, f"{model}_{name}", ts), ["model", "fold"], "y", "pred")
            out = got if out is None else out.unionByName(got)
    raw = assign(df, bounds, ts).filter("role = 'test'").select(F.lit("raw_prior").alias("model"), "fold", F.col(target).alias("y"), F.col(priors[0]).alias("pred"))
    return out.unionByName(errors(raw, ["model", "fold"], "y", "pred"))


def input_gap(analysis: DataFrame, forecast: DataFrame, bounds: DataFrame, fit: Fit, features: list[str], target: str, ts: str = "ts") -> DataFrame:
    """Train on analysed inputs, predict from both inputs on their common hours, and compare the pooled errors."""
    common = forecast.select(ts, *[F.col(f).alias(f"_fc_{f}") for f in features])
    rows = assign(analysis.join(common, ts), bounds, ts)
    out = None
    for r in bounds.select("fold").collect():
        own = rows.filter(F.col("fold") == r["fold"])
        predict = fit(own.filter("role = 'train'"), features, target)
        test = own.filter("role = 'test'")
        swapped = test.drop(*features).withColumnsRenamed({f"_fc_{f}": f for f in features})
        for name, part in (("analysis", test), ("forecast", swapped)):
            got = predict(part).select(F.lit(name).alias("input"), F.col(target).alias("y"), clip("pred", 0.0, 1.5).alias("pred"))
            out = got if out is None else out.unionByName(got)
    met = errors(out, ["input"], "y", "pred")
    base = met.filter("input = 'analysis'").select(F.col("mae").alias("_b"))
    return met.crossJoin(F.broadcast(base)).withColumn("mae_change", F.try_divide(F.col("mae") - F.col("_b"), F.col("_b"))).drop("_b")


def permutation_importance(df: DataFrame, predict, features: list[str], target: str, seed: int = 42) -> DataFrame:
    """Rise of the mean absolute error where one feature is taken from another row, by hash order, for each feature."""
    rows = df.dropna(subset=[*features, target]).withColumn("_h", F.xxhash64(F.lit(seed), *features))
    w = Window.partitionBy(F.pmod("_h", F.lit(64))).orderBy("_h")
    base = predict(rows.drop("_h")).agg(F.avg(F.abs(F.col(target) - F.col("pred")))).first()[0]
    out = None
    for f in features:
        mixed = rows.withColumn(f, F.coalesce(F.lag(f, 7).over(w), F.col(f))).drop("_h")
        got = predict(mixed).agg((F.avg(F.abs(F.col(target) - F.col("pred"))) - F.lit(base)).alias("importance")).select(F.lit(f).alias("feature"), "importance")
        out = got if out is None else out.unionByName(got)
    return out


def population_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each column; the deviation is 1 where a column does not vary."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}
