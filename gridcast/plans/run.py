"""The two modes of the engine: training (matrix, folds, learners, stores) and the day-ahead forecast of all districts."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import publish, read_store
from . import forecast
from .ml import Fit
from .training import train

LOG = logging.getLogger("gridcast")
BANDS = ("lower_mw", "median_mw", "upper_mw")


def train_mode(matrix: DataFrame, learners: dict[str, Fit], features: dict[str, list[str]], store: str, **how) -> None:
    """Evaluate the learners on each technology's capacity factor and upsert the stores."""
    for tech, own in features.items():
        LOG.info("training %s", tech)
        train(matrix, learners, own, (tech,), store, **how)


def forecast_mode(features: DataFrame, predictors: dict[str, Callable[[DataFrame], DataFrame]], calibration: DataFrame, fleets: DataFrame, now: F.Column, hours: int = 24) -> DataFrame:
    """District forecasts by hour: bands of each technology in MW from the next full hour on; raises where a district is incomplete.

    features: district, ts and what the predictors read; predictors add lo, pred and hi (capacity factors); calibration: technology, scale, offset and
    optionally conformal_q and conformal_floor; fleets: district, technology, cap_mw.
    """
    ahead = forecast.horizon(features, ["district"], "ts", now, hours)
    out = None
    for tech, predict in predictors.items():
        own = fleets.filter(F.col("technology") == tech).select("district", "cap_mw")
        rules = calibration.filter(F.col("technology") == tech).drop("technology")
        rows = predict(ahead).select("district", "ts", F.col("lo").alias("q10"), F.col("pred").alias("q50"), F.col("hi").alias("q90"))
        # A technology has one row of calibration; without any it stands as predicted.
        rows = rows.join(own, "district").join(F.broadcast(rules.limit(1)), how="left")
        rows = rows.withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "offset": F.coalesce("offset", F.lit(0.0))})
        got = forecast.downscale(rows).select("district", "ts", *[F.col(b).alias(f"{tech}_{b}") for b in BANDS], F.col("cap_mw").alias(f"{tech}_nameplate_mw"))
        out = got if out is None else out.join(got, ["district", "ts"])
    return forecast.complete(out, fleets, "district", hours)


def run(spark: SparkSession, mode: str, store: str, **parts) -> None:
    """``train``: see ``train_mode``. ``forecast``: the district table to ``{store}/forecast`` and its sums to ``{store}/state``."""
    if mode == "train":
        train_mode(store=store, **parts)
    elif mode == "forecast":
        table = forecast_mode(**parts)
        publish(table, f"{store}/forecast")
        held = read_store(spark, f"{store}/forecast")
        publish(forecast.state_total(held, "ts", [c for c in held.columns if c not in ("district", "ts")]), f"{store}/state")
        LOG.info("forecast written to %s", store)
    else:
        raise ValueError("mode must be train or forecast")
