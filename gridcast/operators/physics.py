"""Power curves, turbine matching, regional priors and solar position."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean_name, clip, col

PERFORMANCE_RATIO = 0.80
REFERENCE_KW = 3000.0


def unpivot_curves(wide: DataFrame, id_cols: list[str]) -> DataFrame:
    """Columns named ``kW at {v} m/s`` to rows (v, kw)."""
    speeds = [c for c in wide.columns if c.startswith("kW at ")]
    long = wide.unpivot(id_cols, [F.col(f"`{c}`") for c in speeds], "_name", "kw")
    return long.withColumn("v", F.regexp_extract("_name", r"kW at ([\d.]+) m/s", 1).cast("double")).drop("_name").filter("kw IS NOT NULL")


def segments(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring knots of each curve: va, ka, vb, kb, and whether the segment is the last (closed at its end)."""
    w = Window.partitionBy(*keys).orderBy("v")
    seg = curve.select(*keys, F.col("v").alias("va"), F.col("kw").alias("ka"), F.lead("v").over(w).alias("vb"), F.lead("kw").over(w).alias("kb"))
    top = F.max("vb").over(Window.partitionBy(*keys))
    return seg.filter("vb IS NOT NULL").withColumn("closed", F.col("vb") == top)


def power_at(speeds: DataFrame, curve: DataFrame, keys: list[str], v: str = "v_in", name: str = "kw") -> DataFrame:
    """Piecewise-linear power: 0 outside the table, null for a null speed. Curves are small tables with keys in common."""
    seg = F.array_sort(F.collect_list(F.struct("v", "kw")))
    packed = curve.groupBy(*keys).agg(seg.alias("_c"))
    joined = speeds.join(packed, keys, "left")
    x = F.col(v)
    at = F.filter("_c", lambda p: p["v"] <= x)
    n = F.size(at)
    a, b = F.try_element_at("_c", n), F.try_element_at("_c", n + 1)
    inside = F.when(b["v"].isNull(), F.when(a["v"] == x, a["kw"]).otherwise(0.0)).otherwise(a["kw"] + (b["kw"] - a["kw"]) * (x - a["v"]) / (b["v"] - a["v"]))
    return joined.withColumn(name, F.when(x.isNotNull(), F.when(F.coalesce(n, F.lit(0)) > 0, inside).otherwise(0.0))).drop("_c")


def cubic_power_at(speeds: DataFrame, v_knots: list[float], kw_knots: list[float], v: str = "v_in", name: str = "kw") -> DataFrame:
    """Natural cubic spline through the knots (one small curve), 0 outside; by Arrow batches."""
    x, y = np.asarray(v_knots, float), np.asarray(kw_knots, float)
    h = np.diff(x)
    a = np.diag(np.concatenate(([1.0], 2 * (h[:-1] + h[1:]), [1.0])))
    for i in range(1, len(x) - 1):
        a[i, i - 1], a[i, i + 1] = h[i - 1], h[i]
    rhs = np.concatenate(([0.0], 6 * (np.diff(y)[1:] / h[1:] - np.diff(y)[:-1] / h[:-1]), [0.0]))
    m = np.linalg.solve(a, rhs)

    @F.pandas_udf("double")
    def spline(s: pd.Series) -> pd.Series:
        z = s.to_numpy(float)
        i = np.clip(np.searchsorted(x, z, "right") - 1, 0, len(x) - 2)
        d, e = x[i + 1] - z, z - x[i]
        out = m[i] * d**3 / (6 * h[i]) + m[i + 1] * e**3 / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * d + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * e
        return pd.Series(np.where(np.isnan(z), np.nan, np.where((z < x[0]) | (z > x[-1]), 0.0, out)))

    return speeds.withColumn(name, spline(v)).withColumn(name, F.when(~F.isnan(name), F.col(name)))


def capped_power(kw: Column | str, gross: Column | str, rated: Column | str) -> Column:
    """Between 0 and the gross power, or the rated where the gross is missing or not positive."""
    return clip(kw, 0.0, F.when(col(gross) > 0, col(gross)).otherwise(col(rated)))


def _within(value: Column, target: Column, share: float) -> Column:
    gap = F.abs(value - target)
    band = target * share
    return F.when((gap < band) & (band > 0), F.lit(5.0) * (F.lit(1.0) - gap / band)).otherwise(0.0)


def match_turbines(assets: DataFrame, curves: DataFrame) -> DataFrame:
    """The best curve of each asset by additive score, or the nearest capacity where no score reaches 5.

    assets: asset, manufacturer, type, gross_kw, rotor. curves: curve, ord, maker, turbine, rated_kw. Curves are a registry of some
    hundred rows: distinct asset descriptions (not assets) meet all of them, and the best joins back.
    Points: 10 for the manufacturer (either name within the other), 5 falling to 0 at 15 % off in power and at 10 % off in rotor
    (the first number in the turbine's name), 8 for the type. The first curve in file order wins ties. With a known
    manufacturer only its curves compete; where those stay under 15 all compete without manufacturer points and replace only by more.
    """
    kinds = ["manufacturer", "type", "gross_kw", "rotor"]
    asked = assets.select(*kinds).distinct().withColumns({"_m": clean_name("manufacturer"), "_t": clean_name("type"), "_id": F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in kinds])})
    shelf = curves.select("curve", "ord", "rated_kw", clean_name("maker").alias("_cm"), clean_name("turbine").alias("_ct"), F.regexp_extract("turbine", r"(\d+)", 1).try_cast("double").alias("_cr"))
    both = asked.crossJoin(shelf)  # the planner broadcasts the registry where its size allows
    either = lambda a, b: (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))
    maker = F.when(either(F.col("_m"), F.col("_cm")), 10.0).otherwise(0.0)
    rest = F.coalesce(_within(F.col("rated_kw"), F.col("gross_kw"), 0.15), F.lit(0.0)) + F.coalesce(_within(F.col("_cr"), F.col("rotor"), 0.10), F.lit(0.0)) + F.when(either(F.col("_t"), F.col("_ct")), 8.0).otherwise(0.0)
    scored = both.withColumns({"_own": (F.length("_m") > 0) & F.contains("_cm", F.col("_m")), "_full": maker + rest, "_rest": rest, "_gap": F.abs(F.col("rated_kw") - F.col("gross_kw"))})
    pool = Window.partitionBy("_id")
    scored = scored.withColumn("_some", F.max("_own").over(pool))
    first = lambda score, where: F.max(F.when(where, F.struct(score.alias("s"), (-F.col("ord")).alias("o"), F.col("curve").alias("curve"))))
    best = scored.groupBy("_id", *kinds).agg(
        first(F.col("_full"), F.col("_own") | ~F.col("_some")).alias("a"),
        F.max("_some").alias("_some"),
        first(F.col("_rest"), F.lit(True)).alias("b"),
        F.min(F.when(F.col("_gap").isNotNull(), F.struct("_gap", "ord", "curve"))).alias("c"),
    )
    again = F.col("_some") & (F.col("a.s") < 15) & (F.col("b.s") > F.col("a.s"))
    score, curve = F.when(again, F.col("b.s")).otherwise(F.col("a.s")), F.when(again, F.col("b.curve")).otherwise(F.col("a.curve"))
    chosen = best.select(*[F.col(k).alias(f"_q_{k}") for k in kinds], score.alias("score"), F.when(score >= 5, curve).otherwise(F.col("c.curve")).alias("curve"))
    on = F.lit(True)
    for k in kinds:
        on = on & F.col(k).eqNullSafe(F.col(f"_q_{k}"))
    return assets.join(chosen, on, "left").select(*assets.columns, "score", "curve")


def regional_sum(per_unit: DataFrame, capacity: DataFrame, node: list[str], ts: str, value: str, name: str = "prior_mw") -> DataFrame:
    """Sum over clusters of capacity times the node's per-unit value, by hour; all-null hours are 0.

    As the value depends on the node alone, capacities are summed by node first: one row per node and hour instead of one per cluster.
    """
    total = capacity.groupBy(*node).agg(F.sum("capacity_mw").alias("_cap"))
    return per_unit.join(total, node).groupBy(ts).agg(F.coalesce(F.sum(F.col(value) * F.col("_cap")), F.lit(0.0)).alias(name))


def regional_mean(weather: DataFrame, nodes: DataFrame, node: list[str], ts: str, values: list[str]) -> DataFrame:
    """Unweighted mean over distinct nodes, by hour."""
    return weather.join(nodes.select(*node).distinct(), node, "left_semi").groupBy(ts).agg(*[F.avg(v).alias(v) for v in values])


def wind_per_unit(kmh: Column | str, curve_kw: Column | str, reference: float = REFERENCE_KW) -> Column:
    return clip(col(curve_kw) / F.lit(reference), 0.0, 1.0)


def solar_per_unit(shortwave: Column | str) -> Column:
    return col(shortwave) / F.lit(1000.0) * F.lit(PERFORMANCE_RATIO)


def solar_position(ts: Column | str, lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """(zenith, azimuth) in degrees, by Spencer's series; ``ts`` is UTC. Good to some tenths of a degree, without refraction."""
    ts, lat = col(ts), F.radians(col(lat))
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    g = F.lit(2.0) * F.pi() / 365.0 * (F.dayofyear(ts) - 1 + (hour - 12) / 24.0)
    decl = F.lit(0.006918) - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    eqtime = F.lit(229.18) * (F.lit(0.000075) + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    angle = F.radians((hour * 60 + eqtime + 4 * col(lon)) / 4 - 180)
    cosz = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(angle)
    zenith = F.degrees(F.acos(clip(cosz, -1.0, 1.0)))
    azimuth = F.degrees(F.atan2(F.sin(angle), F.cos(angle) * F.sin(lat) - F.tan(decl) * F.cos(lat))) + 180
    return zenith, azimuth


def refracted(zenith: Column, pressure_hpa: float = 1010.0, celsius: float = 10.0) -> Column:
    """The apparent zenith: raised by the atmosphere's refraction while the upper limb can be seen."""
    up = F.lit(90.0) - zenith
    arc = F.lit(pressure_hpa / 1010.0 * 283.0 / (273.0 + celsius) * 1.02 / 60.0) / F.tan(F.radians(up + F.lit(10.3) / (up + 5.11)))
    return F.when(up > -0.83, zenith - arc).otherwise(zenith)


def clear_sky_turbid(apparent: Column, ts: Column | str, turbidity: float = 3.0, altitude: float = 0.0) -> Column:
    """Clear-sky irradiance in W/m2 after Ineichen and Perez (2002) by Linke turbidity and altitude; air mass after Kasten and Young (1989)."""
    c = F.cos(F.radians(apparent))
    mass = F.lit(float(np.exp(-altitude / 8434.5))) / (c + F.lit(0.50572) * F.pow(F.lit(96.07995) - apparent, F.lit(-1.6364)))
    day = F.lit(2.0) * F.pi() / 365.0 * (F.dayofyear(col(ts)) - 1)
    beyond = F.lit(1366.1) * (F.lit(1.00011) + 0.034221 * F.cos(day) + 0.00128 * F.sin(day) + 0.000719 * F.cos(2 * day) + 7.7e-05 * F.sin(2 * day))
    low, high = float(np.exp(-altitude / 8000.0)), float(np.exp(-altitude / 1250.0))
    gain, loss = 5.09e-5 * altitude + 0.868, 3.92e-5 * altitude + 0.0387
    value = beyond * gain * c * F.exp(F.lit(-loss * (low + high * (turbidity - 1))) * mass) * F.exp(F.lit(0.01) * F.pow(mass, F.lit(1.8)))
    return F.when(apparent.isNotNull(), F.when(c > 0, clip(value, 0.0)).otherwise(0.0))


def with_geometry(weather: DataFrame, geometry: DataFrame | None, keys: tuple[str, ...] = ("cluster_id", "ts")) -> DataFrame:
    """Hourly weather of clusters on the hours for which there is solar geometry; all of it where there is no geometry at all."""
    return weather if geometry is None else weather.join(geometry, list(keys))


def solar_prior(weather: DataFrame, capacity: DataFrame, geometry: DataFrame | None = None, value: str = "shortwave_radiation", name: str = "prior_mw") -> DataFrame:
    """The regional solar prior by hour: each cluster's irradiance, gated by geometry, times its capacity; all-null hours are 0.

    weather: cluster_id, ts; capacity: cluster_id, capacity_mw.
    """
    rows = with_geometry(weather, geometry).withColumn("_pu", solar_per_unit(value))
    return regional_sum(rows, capacity, ["cluster_id"], "ts", "_pu", name)


def clear_sky(zenith: Column) -> Column:
    """Haurwitz clear-sky irradiance in W/m2, 0 at night."""
    c = F.cos(F.radians(zenith))
    return F.when(zenith.isNotNull(), F.when(c > 0, F.lit(1098.0) * c * F.exp(F.lit(-0.057) / c)).otherwise(0.0))


def solar_fleet(sites: DataFrame, start: str, end: str, step: str = "15 minutes", zone: str = "Europe/Berlin") -> DataFrame:
    """(site, ts, zenith, azimuth, ghi) of every site on the local grid between two wall-clock times, both included.

    Sites are dealt evenly and each makes its own grid, so there is neither a join nor a shuffle of grid rows.
    """
    edge = lambda x: F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(x).cast("timestamp_ntz"))
    grid = F.explode(F.sequence(edge(start), edge(end), F.expr(f"INTERVAL {step}")))
    dealt = sites.repartition(max(1, sites.sparkSession.sparkContext.defaultParallelism * 4), "site")
    zenith, azimuth = solar_position("ts", "lat", "lon")
    return dealt.withColumn("ts", grid).withColumns({"zenith": zenith, "azimuth": azimuth}).select("site", "ts", "zenith", "azimuth", clear_sky(F.col("zenith")).alias("ghi"))
