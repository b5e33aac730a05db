"""Physical schemas of the entities and the feature contract."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Feature columns of the capacity-factor matrix, in contract order (fixed values).
FEATURES = ("wind_prior_cf", "solar_prior_cf", "temperature_2m", "surface_pressure", "relative_humidity_2m", "hour_sin", "hour_cos", "month_sin", "month_cos")
TECHNOLOGIES = ("wind", "solar")
CF_CLIP = 1.5

#: DDL by entity.
DDL = {
    "wind_asset": "unit_id string, updated string, lon double, lat double, commissioned string, retired string, gross_kw double, net_kw double, manufacturer string, technology string, type string, hub_height double, rotor_diameter double",
    "solar_asset": "unit_id string, updated string, lon double, lat double, commissioned string, retired string, gross_kw double, net_kw double, ground_mounted boolean, azimuth double, tilt double, battery boolean",
    "cluster": "cluster_id string, lat double, lon double, capacity_mw double, assets bigint",
    "power_curve": "curve_id bigint, manufacturer string, turbine string, v double, kw double",
    "target": "ts timestamp_ntz, wind_mw double, solar_mw double",
    "weather": "node_lat int, node_lon int, ts timestamp_ntz, temperature_2m double, relative_humidity_2m double, surface_pressure double, cloud_cover double, wind_speed_10m double, wind_speed_100m double, wind_direction_10m double, wind_direction_100m double, shortwave_radiation double, direct_radiation double, diffuse_radiation double, direct_normal_irradiance double",
    "telemetry": "region string, ts timestamp, biomass double, solar double, wind double, other double, regional_total double, industry double, public double, households double, autarky double, solar_share double, co2_tons double, cloud_pct double",
    "metric": "model string, technology string, fold int, scale string, n bigint, mae double, rmse double, mbe double, nmae double, nrmse double, corr double, picp double, mpiw double",
    "oof": "ts timestamp_ntz, technology string, fold int, model string, prior_cf double, y_cf double, cap_mw double, y_mw double, pred_cf double, pred_mw double, lo_cf double, hi_cf double",
    "calibration": "municipality string, model string, technology string, scale double, offset double, cap_mw double, conformal_q double, conformal_floor double",
    "coverage": "scope string, municipality string, technology string, model string, fold int, cal_fold int, n bigint, picp_before double, picp_after double, mpiw_before double, mpiw_after double, q double, floor double",
}


def known_reals(technology: str) -> tuple[str, ...]:
    """The features known ahead for one technology: its own prior and the seven shared ones."""
    return (f"{technology}_prior_cf", *FEATURES[2:])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` unchanged; raises if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def available(df: DataFrame, *columns: str) -> DataFrame:
    """Of the wanted columns those that exist, in the wanted order."""
    return df.select(*[c for c in columns if c in df.columns])
