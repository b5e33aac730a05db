"""The capacity-factor matrix and the municipal feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, cyclic
from ..operators.clean import capacity_factor
from ..operators.timeseries import effective_capacity, resample_mean
from ..schemas import CF_CLIP

MODES = ("reanalysis", "forecast")


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    hs, hc = cyclic(F.hour(ts), 24)
    ms, mc = cyclic(F.month(ts), 12)
    return df.withColumns({"hour_sin": hs, "hour_cos": hc, "month_sin": ms, "month_cos": mc})


def feature_matrix(target: DataFrame, priors: dict[str, DataFrame], weather: DataFrame, fleet_mw: dict[str, float], ts: str = "ts", mode: str = "reanalysis", days: int = 365, least: int = 720) -> DataFrame:
    """Target, priors and mean weather on common hours, with calendar, prior and target capacity factors; complete rows only.

    target: ts, {tech}_mw; priors: by technology (ts, prior_mw).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    out = target
    for tech, prior in priors.items():
        out = out.join(prior.withColumnRenamed("prior_mw", f"{tech}_prior_mw"), ts)
    out = calendar(out.join(weather, ts), ts).withColumn("_series", F.lit(0))
    for tech in priors:
        out = out.withColumn(f"{tech}_prior_cf", clip(F.try_divide(F.col(f"{tech}_prior_mw"), F.lit(float(fleet_mw[tech]))), 0.0, CF_CLIP))
        out = effective_capacity(out, ["_series"], ts, f"{tech}_mw", days=days, least=least, name=f"{tech}_cap_mw")
        out = out.withColumn(f"{tech}_cf", capacity_factor(f"{tech}_mw", f"{tech}_cap_mw", CF_CLIP))
    return out.drop("_series").dropna()


def capacity_by_year(df: DataFrame, keys: list[str], ts: str, cap: str) -> DataFrame:
    """The last capacity of each year that is not null."""
    rows = df.filter(F.col(cap).isNotNull())
    return rows.groupBy(*keys, F.year(ts).cast("long").alias("year")).agg(F.max_by(cap, ts).alias(cap))


def capacity_audit(df: DataFrame, keys: list[str], ts: str, value: str, cap: str) -> DataFrame:
    """By year: maximum, p99.9, rows, and the share of rows above the capacity in percent."""
    over = F.avg((F.col(value) > F.col(cap)).cast("int")) * 100
    return df.groupBy(*keys, F.year(ts).cast("long").alias("year")).agg(F.max(value).alias("peak"), F.percentile(value, F.lit(0.999)).alias("p999"), F.count(value).alias("n"), over.alias("over_pct"))


def municipal_matrix(assets: DataFrame, weather: DataFrame, actuals: DataFrame, ts: str = "ts") -> DataFrame:
    """Hourly priors of a site from its own assets, mean weather of its nodes, calendar and measured means, by region.

    assets: region, technology, node_lat, node_lon, kw, per unit in weather as wind_pu and solar_pu. Technologies without assets are 0.
    """
    node = ["node_lat", "node_lon"]
    own = assets.groupBy("region", *node).agg(*[F.sum(F.when(F.col("technology") == t, F.col("kw"))).alias(f"_{t}") for t in ("wind", "solar")])
    hours = weather.join(own, node)
    prior = lambda t: F.coalesce(F.sum(F.col(f"{t}_pu") * F.col(f"_{t}")), F.lit(0.0)) / 1000.0
    names = [c for c in ("temperature_2m", "surface_pressure", "relative_humidity_2m") if c in weather.columns]
    out = hours.groupBy("region", ts).agg(prior("wind").alias("wind_prior_mw"), prior("solar").alias("solar_prior_mw"), *[F.avg(c).alias(c) for c in names])
    cap = assets.groupBy("region").agg(*[(F.coalesce(F.sum(F.when(F.col("technology") == t, F.col("kw"))), F.lit(0.0)) / 1000.0).alias(f"{t}_cap_mw") for t in ("wind", "solar")])
    out = calendar(out.join(cap, "region"), ts)
    for t in ("wind", "solar"):
        out = out.withColumn(f"{t}_prior_cf", F.when(F.col(f"{t}_cap_mw") > 0, clip(F.try_divide(F.col(f"{t}_prior_mw"), F.col(f"{t}_cap_mw")), 0.0, CF_CLIP)).otherwise(0.0))
    values = [c for c in actuals.columns if c not in ("region", ts)]
    return out.join(resample_mean(actuals, ["region"], ts, values), ["region", ts])
