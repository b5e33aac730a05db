"""The training run: matrix to folds, learners and baselines, to keep-last stores of metrics and out-of-fold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import upsert_store
from ..sources.writers import METRIC_KEYS, OOF_KEYS
from .baselines import baseline_metrics
from .folds import fold_bounds
from .metrics import metric_rows
from .ml import Fit, cross_validate


def evaluate(matrix: DataFrame, learners: dict[str, Fit], features: list[str], technology: str, ts: str = "ts", n: int = 4, test_days: int = 365, gap_hours: int = 72) -> tuple[DataFrame, DataFrame]:
    """(metric rows, out-of-fold rows) of all learners on one technology's capacity factor."""
    bounds = fold_bounds(matrix, ts, n, test_days, gap_hours)
    cap = f"{technology}_cap_mw"
    oof = None
    for name, fit in learners.items():
        got = cross_validate(matrix, bounds, fit, features, f"{technology}_cf", name, ts, cap)
        oof = got if oof is None else oof.unionByName(got)
    oof = oof.withColumns({"technology": F.lit(technology), "y_mw": F.col("y") * F.col(cap), "pred_mw": F.col("pred") * F.col(cap)}).withColumnRenamed(cap, "cap_mw")
    rows = metric_rows(oof.withColumnsRenamed({"y": "y_cf", "pred": "pred_cf"}), ["model", "technology", "fold"])
    naive = baseline_metrics(matrix.withColumn("technology", F.lit(technology)), bounds, ["technology"], ts, f"{technology}_cf", {"hour": F.hour(ts), "month": F.month(ts)}).withColumn("scale", F.lit("cf"))
    return rows.unionByName(naive), oof.withColumnsRenamed({ts: "ts", "y": "y_cf", "pred": "pred_cf", "lo": "lo_cf", "hi": "hi_cf"})


def train(matrix: DataFrame, learners: dict[str, Fit], features: list[str], technologies: tuple[str, ...], store: str, **how) -> None:
    """Evaluate every technology and upsert ``{store}/cv_metrics`` and ``{store}/oof``."""
    for tech in technologies:
        metrics, oof = evaluate(matrix, learners, features, tech, **how)
        upsert_store(metrics, f"{store}/cv_metrics", METRIC_KEYS, buckets=1)
        upsert_store(oof, f"{store}/oof", OOF_KEYS)
