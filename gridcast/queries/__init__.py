"""The engine's queries over the test tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import calibration, capacity, forecasting, learning, registry, relational, series, stores
from .common import nudged

MODULES = (series, relational, registry, capacity, calibration, forecasting, learning, stores)


def queries() -> dict:
    return {name: q[0] for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: nudged(q[1]) for m in MODULES for name, q in m.QUERIES.items() if q[1]}
