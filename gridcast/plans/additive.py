"""Additive models by cyclic boosting: a shape function for each feature, and for the pairs of features that add most.

Every round makes one sum over the tasks (see ``gather``) of the residuals by (feature, bin), for all bags at once; each feature's table moves a small step towards
its best steps of ``leaves`` levels. Bags are drawn by a hash of the row; the rows left out decide when a bag stops, and the bags' tables are
averaged. Pairs are ranked by what their joint bins explain of the residuals, and boosted on these like the features before. Tables are centred
over the training rows, from whose counts the importance follows.
"""

from __future__ import annotations

import io
from collections.abc import Generator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gather import Sum, drive, in_tasks, spread
from .trees import BINS, binned, binned_rows, feature_cuts, mixed, row_arrays

GRID = 16  # bins of a pair's feature, besides the one for missing values


@dataclass(frozen=True)
class Shape:
    bins: int = BINS
    pairs: int = 0
    rounds: int = 500
    rate: float = 0.03
    leaves: int = 3
    least: int = 5
    bags: int = 8
    share: float = 0.85
    patience: int = 30
    firm: float = 20.0  # rows of 0 that a pair's cell is drawn towards
    seed: int = 42


def levels(s: np.ndarray, n: np.ndarray, leaves: int, least: int) -> np.ndarray:
    """The best piecewise constant with up to ``leaves`` levels over ordered bins, grown greedily; bin 0 is a level of its own."""
    out = np.zeros(len(s))
    if n[0] >= least:
        out[0] = s[0] / n[0]
    cs, cn = np.concatenate([[0], s[1:].cumsum()]), np.concatenate([[0], n[1:].cumsum()])
    parts = [(0, len(cs) - 1)]

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2 or cn[hi] - cn[lo] < 2 * least:
            return 0.0, -1
        ls, ln = cs[lo + 1 : hi] - cs[lo], cn[lo + 1 : hi] - cn[lo]
        rs, rn = cs[hi] - cs[lo] - ls, cn[hi] - cn[lo] - ln
        gain = np.where((ln >= least) & (rn >= least), ls**2 / np.maximum(ln, 1) + rs**2 / np.maximum(rn, 1), -np.inf) - (cs[hi] - cs[lo]) ** 2 / (cn[hi] - cn[lo])
        at = int(gain.argmax())
        return float(gain[at]), lo + 1 + at

    found = {parts[0]: best(*parts[0])}
    while len(parts) < leaves:
        part = max(parts, key=lambda p: found[p][0])
        gain, at = found[part]
        if gain <= 1e-12:
            break
        parts.remove(part)
        for new in ((part[0], at), (at, part[1])):
            parts.append(new)
            found[new] = best(*new)
    for lo, hi in parts:
        if cn[hi] > cn[lo]:
            out[lo + 1 : hi + 1] = (cs[hi] - cs[lo]) / (cn[hi] - cn[lo])
    return out


def _sums(cells: np.ndarray, weight: np.ndarray | None, width: int) -> np.ndarray:
    """(column, cell) sums of the weights, or counts."""
    at = (cells + np.arange(cells.shape[1]) * width).ravel()
    return np.bincount(at, None if weight is None else np.repeat(weight, cells.shape[1]), cells.shape[1] * width).reshape(-1, width).astype(float)


def boost(cells: np.ndarray, width: int, y: np.ndarray, key: np.ndarray, bag: int, how: Shape, paired: bool) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """The tables (column, cell) of one bag; ``y`` is what is to be explained, with mean 0. Yields arrays to be summed."""
    own = mixed(key, how.seed * 1000 + bag) < np.uint64(int(how.share * 2.0**64))
    inside, outside = np.flatnonzero(own), np.flatnonzero(~own)
    n = yield _sums(cells[inside], None, width)
    tables, rest = np.zeros(n.shape), y.copy()
    best, loss, idle = tables, np.inf, 0
    for _ in range(how.rounds):
        got = yield np.concatenate([_sums(cells[inside], rest[inside], width).ravel(), [(rest[outside] ** 2).sum(), len(outside)]])
        now = got[-2] / got[-1] if got[-1] else loss / 2
        if now < loss:
            best, loss, idle = tables.copy(), now, 0
        else:
            idle += 1
            if idle >= how.patience:
                break
        s = got[:-2].reshape(n.shape)
        step = how.rate * (s / (n + how.firm) if paired else np.stack([levels(a, b, how.leaves, how.least) for a, b in zip(s, n, strict=True)]))
        tables = tables + step
        rest -= step[np.arange(len(step)), cells].sum(1)
    return best


def coarse(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bins of each feature joined to at most ``GRID``; the bin of missing values stays by itself."""
    return np.where(bins == 0, 0, 1 + (bins.astype(np.int64) - 1) * GRID // np.maximum(sizes, GRID))


def pair_cells(grid: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.stack([grid[:, a] * (GRID + 1) + grid[:, b] for a, b in pairs], 1) if pairs else np.zeros((len(grid), 0), np.int64)


class Additive:
    """A start, a table of effects by bin for each feature, and by cell for each chosen pair. Calls add ``pred``."""

    def __init__(self, features: list[str], cuts: list[np.ndarray], base: float, tables: np.ndarray, pairs: list[tuple[int, int]], grids: np.ndarray, counts: np.ndarray, grid_counts: np.ndarray):
        self.features, self.cuts, self.base, self.tables, self.pairs, self.grids, self.counts, self.grid_counts = features, cuts, base, tables, pairs, grids, counts, grid_counts

    def effects(self, x: np.ndarray) -> np.ndarray:
        """The effect of every feature, then of every pair, on each row."""
        bins = binned(x, self.cuts)
        cells = pair_cells(coarse(bins, np.array([len(c) + 1 for c in self.cuts])), self.pairs)
        return np.concatenate([self.tables[np.arange(bins.shape[1]), bins], self.grids[np.arange(cells.shape[1]), cells]], 1)

    def __call__(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def predicted(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(model.base + model.effects(frame.to_numpy(float, na_value=np.nan)).sum(1))

        return df.withColumn("pred", predicted(F.struct(*[F.col(f).cast("double") for f in self.features])))

    def names(self) -> list[str]:
        return [*self.features, *[f"{self.features[a]} x {self.features[b]}" for a, b in self.pairs]]

    def importance(self, _df: DataFrame | None = None) -> DataFrame:
        """(feature, importance): the mean absolute effect of every feature and pair (``a x b``) over the training rows."""
        mean = lambda t, n: (np.abs(t) * n).sum(1) / np.maximum(n.sum(1), 1)
        both = [*mean(self.tables, self.counts), *mean(self.grids, self.grid_counts)]
        return SparkSession.active().createDataFrame([(n, float(v)) for n, v in zip(self.names(), both, strict=True)], "feature string, importance double")

    def shape(self) -> DataFrame:
        """(feature, bin, upto, effect, n): the shape functions as rows; bin 0 holds missing values, ``upto`` is its upper edge (null for the last)."""
        rows = [(f, b, float(c[b - 1]) if 0 < b <= len(c) else None, float(t[b]), int(n[b])) for f, c, t, n in zip(self.features, self.cuts, self.tables, self.counts, strict=True) for b in range(len(c) + 2)]
        return SparkSession.active().createDataFrame(rows, "feature string, bin int, upto double, effect double, n long")

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, base=self.base, tables=self.tables, pairs=np.array(self.pairs, np.int64).reshape(-1, 2), grids=self.grids, counts=self.counts, grid_counts=self.grid_counts, **{f"cuts{i}": c for i, c in enumerate(self.cuts)})
        return out.getvalue()

    @staticmethod
    def unpacked(features: list[str], data: bytes) -> Additive:
        with np.load(io.BytesIO(data)) as held:
            pairs = [(int(a), int(b)) for a, b in held["pairs"]]
            return Additive(features, [held[f"cuts{i}"] for i in range(len(features))], float(held["base"]), held["tables"], pairs, held["grids"], held["counts"], held["grid_counts"])

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(self.features, bytearray(self.packed()))], "features array<string>, model binary").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> Additive:
        row = SparkSession.active().read.parquet(path).first()
        return Additive.unpacked(list(row["features"]), bytes(row["model"]))


def centred(tables: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Tables with mean 0 over the rows."""
    return tables - (tables * n).sum(1, keepdims=True) / np.maximum(n.sum(1, keepdims=True), 1)


def fit_additive(train: DataFrame, features: list[str], target: str, how: Shape, per_task: int) -> Additive:
    rows = train.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    cuts = feature_cuts(rows, features, how.bins)
    dealt, parts = spread(binned_rows(rows, features, target, cuts), per_task)
    sizes = np.array([len(c) + 1 for c in cuts])

    def work(tab: pa.Table, summed: Sum, task: int) -> bytes | None:
        bins, y, key = row_arrays(tab, len(features))
        total = summed(np.array([y.sum(), len(y)]))
        base = total[0] / total[1] if total[1] else 0.0
        width = BINS + 1
        n = summed(_sums(bins.astype(np.int64), None, width))
        bags = drive([boost(bins.astype(np.int64), width, y - base, key, b, how, False) for b in range(how.bags)], summed, parts == 1)
        tables = centred(np.mean(bags, 0), n)
        rest = y - base - tables[np.arange(len(features)), bins].sum(1)
        grid, every, cells = coarse(bins, sizes), list(combinations(range(len(features)), 2)), (GRID + 1) ** 2
        chosen: list[tuple[int, int]] = []
        if how.pairs and every:
            # A pair at a time, so that the rows' cells for all pairs never stand side by side.
            both = summed(np.stack([np.stack([_sums(pair_cells(grid, [p]), w, cells)[0] for w in (rest, None)]) for p in every]))
            gain = (both[:, 0] ** 2 / (both[:, 1] + how.firm)).sum(1)
            chosen = [every[i] for i in np.argsort(-gain, kind="stable")[: how.pairs]]
        own = pair_cells(grid, chosen)
        grid_n = summed(_sums(own, None, cells)) if chosen else np.zeros((0, cells))
        grids = np.zeros((0, cells))
        if chosen:
            bags = drive([boost(own, cells, rest, key, how.bags + b, how, True) for b in range(how.bags)], summed, parts == 1)
            grids = centred(np.mean(bags, 0), grid_n)
        return Additive(list(features), cuts, float(base), tables, chosen, grids, n, grid_n).packed() if task == 0 else None

    return Additive.unpacked(list(features), in_tasks(dealt, parts, work))
