"""Column expressions; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_KM_CLUSTER = 6371.0088
MISSING = ("", "-", "n.v.", "N.V.", "nv", "NV", "nan")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """``x`` within bounds; null stays null (bare greatest and least would return the bound)."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def is_finite(x: Column | str) -> Column:
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite(x: Column | str) -> Column:
    """``x`` as a double, null where it is NaN or infinite."""
    x = col(x).cast("double")
    return F.when(is_finite(x), x)


def as_double(x: Column | str) -> Column:
    """Text to double: trimmed; empty and invalid become null, NaN and infinities too."""
    return finite(F.nullif(F.trim(col(x)), F.lit("")).try_cast("double"))


def decimal_comma(x: Column | str) -> Column:
    """``1,5`` to 1.5; placeholders and what does not parse (such as ``1.234,5``) become null."""
    x = F.trim(col(x))
    return finite(F.when(x.isin(*MISSING), None).otherwise(F.replace(x, F.lit(","), F.lit("."))).try_cast("double"))


def grouped_decimal_comma(x: Column | str) -> Column:
    """As ``decimal_comma``, but with points as thousands separators."""
    x = F.trim(col(x))
    return decimal_comma(F.when(x.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(x, F.lit("."), F.lit(""))).otherwise(x))


def snap(x: Column | str, grid: float = 0.1) -> Column:
    """The integer number of grid steps nearest to ``x``, halves to even; integers join exactly."""
    return F.rint(col(x) / F.lit(grid)).cast("int")


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def ratio(a, b, otherwise=None) -> Column:
    """a / b, or ``otherwise`` where b is zero or null."""
    out = F.try_divide(col(a), col(b))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def hour_floor(ts: Column | str) -> Column:
    """The start of the hour; keeps the timestamp type whatever the session's zone."""
    return F.window(col(ts), "1 hour")["start"]


def hour_ceil(ts: Column | str) -> Column:
    ts = col(ts)
    floor = ts - F.make_dt_interval(mins=F.minute(ts), secs=F.extract(F.lit("SECOND"), ts))
    return F.when(floor == ts, ts).otherwise(floor + F.expr("INTERVAL 1 HOUR"))


def zero_fill_code(x: Column | str, width: int = 5) -> Column:
    """Left-padded with zeros; longer codes are not cut."""
    x = F.trim(col(x))
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def clean_name(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]", "")


def power_law(v, height, reference: float = 100.0, alpha: float = 0.14) -> Column:
    return col(v) * F.pow(col(height) / F.lit(reference), F.lit(alpha))


def lookup(code, pairs: dict[str, float | str]) -> Column:
    """The value of a code in a literal map, null where it is absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), col(code))
