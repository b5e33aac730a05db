"""Filters, imputation, deduplication and keep-last upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clip, col, finite, is_finite, lookup

#: Orientation codes of the registry in degrees, tilt codes as band centres, manufacturer codes (fixed values).
AZIMUTH = {"695": 0.0, "696": 45.0, "697": 90.0, "698": 135.0, "699": 180.0, "700": 225.0, "701": 270.0, "702": 315.0}
TILT = {"806": 90.0, "807": 75.0, "808": 50.5, "809": 30.5, "810": 12.5}
MANUFACTURERS = {
    "1584": "Siemens", "1586": "Enercon", "1587": "Enercon", "1593": "Fuhrländer", "1596": "Gamesa", "1597": "GE Energy", "1598": "GE Energy", "1625": "Neg Micon", "1627": "Nordex",
    "1628": "Nordex", "1645": "Senvion", "1657": "Senvion", "1660": "Vestas", "1666": "Siemens", "2888": "Repower", "2889": "Repower", "1001682": "Nordex",
}
STATES = ("1400", "14")
ACTIVE = "35"


def registry_filter(df: DataFrame, state: str, first_status: str, second_status: str) -> DataFrame:
    """Active units of the state; the status is the first that is not empty."""
    status = F.coalesce(F.nullif(col(first_status), F.lit("")), col(second_status))
    return df.filter(col(state).isin(*STATES) & (status == ACTIVE))


def impute_coordinates(df: DataFrame, lookup_df: DataFrame, key: str, centroid: tuple[float, float]) -> DataFrame:
    """If either coordinate is missing both come from the lookup (first row of a key by ``ord``), else the centroid; adds ``imputed``.

    The lookup is a postal table; it joins by key, and is broadcast only if the optimizer sees that it is small.
    """
    first = keep_first(lookup_df, [key], "ord").select(key, F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    joined = df.join(first, key, "left")
    return joined.withColumns({
        "imputed": missing,
        "_nlat": F.when(missing, F.coalesce("_plat", F.lit(centroid[0]))).otherwise(F.col("lat")),
        "_nlon": F.when(missing, F.coalesce("_plon", F.lit(centroid[1]))).otherwise(F.col("lon")),
    }).drop("lat", "lon", "_plat", "_plon").withColumnsRenamed({"_nlat": "lat", "_nlon": "lon"})


def orientation(code: Column | str) -> Column:
    return lookup(code, AZIMUTH)


def tilt(code: Column | str) -> Column:
    return lookup(code, TILT)


def manufacturer(code: Column | str) -> Column:
    """The manufacturer's name, empty where the code is unknown."""
    return F.coalesce(lookup(col(code).cast("string"), MANUFACTURERS), F.lit(""))


def flag(code: Column | str, yes: str) -> Column:
    """True where the code is ``yes``; never null."""
    return F.coalesce(col(code) == yes, F.lit(False))


def as_flag(x: Column | str) -> Column:
    """Booleans that arrive as booleans or as text."""
    return F.coalesce(F.lower(col(x).cast("string")) == "true", F.lit(False))


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order (ties are for the caller to break)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return keep_first(df, keys, *[col(o).desc() for o in order])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old and new rows with the last of each key; null keys equal null keys, missing columns become null.

    Rows of ``new`` win over rows of ``old``; within one side the larger ``order`` wins.
    """
    rank = [F.col("_side"), *([F.col(order)] if order else [])]
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, *[r.desc() for r in rank]).drop("_side")


def replace_where(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """Old rows that do not meet the condition (null does not meet it), and all new rows."""
    return old.filter(~F.coalesce(condition, F.lit(False))).unionByName(new, allowMissingColumns=True)


def drop_all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(how="all", subset=columns)


def finite_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns are finite."""
    cond = is_finite(columns[0])
    for c in columns[1:]:
        cond = cond & is_finite(c)
    return df.filter(cond)


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every double column: null is the only missing value inside the engine."""
    return df.withColumns({c: finite(c) for c, t in df.dtypes if t in ("double", "float")})


def capacity_factor(mw: Column | str, cap: Column | str, top: float = 1.5) -> Column:
    return clip(F.try_divide(col(mw), col(cap)), 0.0, top)


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    yes = F.coalesce(condition, F.lit(False))
    return df.filter(yes), df.filter(~yes)


def split_model_name(name: Column | str, suffixes: tuple[str, ...] = ("prior_only", "no_prior", "full")) -> tuple[Column, Column]:
    """(base, variant) of ``base_variant``, longest suffix first; (``m``, ``unknown``) otherwise."""
    pattern = f"^(.*)_({'|'.join(sorted(suffixes, key=len, reverse=True))})$"
    hit = col(name).rlike(pattern)
    return F.when(hit, F.regexp_extract(col(name), pattern, 1)).otherwise("m"), F.when(hit, F.regexp_extract(col(name), pattern, 2)).otherwise("unknown")
