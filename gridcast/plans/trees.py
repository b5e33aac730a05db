"""Histogram boosting of leaf-wise trees on the pinball loss, and exact Shapley values of its predictions.

Rows are binned once, a byte for each feature, and stay in the tasks (see ``gather``). A tree grows by best gain: a heap holds the leaves, and the
leaves that may be split next are opened together, so that a step is one sum over the tasks of (leaf, feature, bin) histograms, shared by the models of all levels; only the child
with fewer rows is counted, its sibling is the difference. Leaves take the loss's quantile of their residuals, found by its digits (32 bits in three sums).
Sampling of rows goes by a hash of the row, so it does not depend on the partitioning.

A model is flat arrays of nodes: it is scored in one Arrow pass, and saved as one small table. Missing features have a bin of their own and go to the side that
gains more. A model without rows predicts 0.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoint import cut
from .gather import Sum, at_once, drive, in_tasks, spread

BINS = 255
FIELDS = ("feature", "limit", "missing_left", "left", "right", "value", "cover")


@dataclass(frozen=True)
class Shape:
    """How trees grow. ``rows`` and ``columns``: the shares that each tree sees; ``l2`` is added to the rows of a leaf in its gain."""

    trees: int = 600
    rate: float = 0.03
    leaves: int = 31
    depth: int = 7
    least: int = 60
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    seed: int = 42


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin 0 where a value is missing, else 1 + the number of cuts under it."""
    out = np.zeros(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(c, x[:, f], side="left"))
    return out


def mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """Uniform 64-bit numbers from keys and a salt."""
    z = key ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def best_splits(hists: np.ndarray, columns: np.ndarray, shape: Shape) -> list[tuple[float, int, int, bool]]:
    """(gain, feature, last bin to the left, missing to the left) for each leaf's histogram (feature, bin, (gradient, rows)); gain 0 if none."""
    own = hists[:, columns]
    g, n = own[..., 0], own[..., 1]
    whole, rows = g[:, :1].sum(2)[..., None], n[:, :1].sum(2)[..., None]
    best: list[tuple[float, int, int, bool]] = [(0.0, 0, 0, False)] * len(hists)
    left_g, left_n = g[:, :, 1:].cumsum(2)[:, :, :-1], n[:, :, 1:].cumsum(2)[:, :, :-1]
    for missing in (False, True):
        if missing:
            if not n[:, :, 0].any():
                break
            left_g, left_n = left_g + g[:, :, :1], left_n + n[:, :, :1]
        rest_n = rows - left_n
        gain = left_g**2 / (left_n + shape.l2 + 1e-300) + (whole - left_g) ** 2 / (rest_n + shape.l2 + 1e-300) - whole**2 / (rows + shape.l2 + 1e-300)
        gain[(left_n < shape.least) | (rest_n < shape.least)] = 0
        flat = gain.reshape(len(hists), -1)
        for i, at in enumerate(flat.argmax(1).tolist()):
            if flat[i, at] > best[i][0]:
                best[i] = (float(flat[i, at]), int(columns[at // gain.shape[2]]), at % gain.shape[2] + 1, missing)
    return best


def _sortable(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the (single precision) values."""
    bits = (v.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _value(key: np.ndarray) -> np.ndarray:
    key = key.astype(np.uint32)
    return np.where(key >> 31, key & np.uint32(0x7FFFFFFF), ~key).view(np.float32).astype(float)


def quantiles(v: np.ndarray, group: np.ndarray, groups: int, level: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """The value of rank ceil(level * n) in each group over all tasks, by its digits; 0 in an empty group."""
    key, prefix = _sortable(v), np.zeros(groups, np.uint32)
    need, have = None, None
    for low, width in ((21, 11), (10, 11), (0, 10)):
        own = np.ones(len(v), bool) if need is None else key >> np.uint32(low + width) == prefix[group]
        digit = (key[own] >> np.uint32(low)).astype(np.int64) & (1 << width) - 1
        count = yield np.bincount(group[own].astype(np.int64) << width | digit, minlength=groups << width).reshape(groups, -1)
        if need is None:
            have = count.sum(1)
            need = np.maximum(1, np.ceil(level * have - 1e-9)).astype(np.int64)
        upto = count.cumsum(1)
        at = (upto >= need[:, None]).argmax(1)
        need -= np.take_along_axis(upto - count, at[:, None], 1)[:, 0]
        prefix = prefix << np.uint32(width) | at.astype(np.uint32)
    return np.where(have > 0, _value(prefix), 0.0)


def _histograms(bins: np.ndarray, g: np.ndarray, leaf: np.ndarray, leaves: int) -> np.ndarray:
    """(leaf, feature, bin, (gradient, rows)) of the rows of each leaf."""
    n, features = bins.shape
    width = BINS + 1
    at = ((leaf[:, None] * features + np.arange(features)) * width + bins).ravel()
    size = leaves * features * width
    return np.stack([np.bincount(at, np.repeat(g, features), size), np.bincount(at, minlength=size)], 1).reshape(leaves, features, width, 2)


def goes_left(bins: np.ndarray, limit, missing_left) -> np.ndarray:
    return (bins <= limit) & ((bins > 0) | missing_left)


def place(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows) and (tree["feature"][at[rows]] >= 0).any():
        rows = rows[tree["feature"][at[rows]] >= 0]
        now = at[rows]
        left = goes_left(bins[rows, tree["feature"][now]], tree["limit"][now], tree["missing_left"][now])
        at[rows] = np.where(left, tree["left"][now], tree["right"][now])
    return at


def grow(bins: np.ndarray, g: np.ndarray, columns: np.ndarray, shape: Shape) -> Generator[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """One tree on the gradients of the rows at hand; values are left at 0."""
    at = np.zeros(len(bins), np.int64)
    root = (yield _histograms(bins, g, at, 1))[0]
    # node: [histogram, depth, split, children or None once opened]
    nodes: list[list] = [[root, 0, best_splits(root[None], columns, shape)[0], None]]
    heap, leaves = [(-nodes[0][2][0], 0)] if nodes[0][2][0] > 1e-12 else [], 1
    split: set[int] = set()
    while heap and leaves < shape.leaves:
        # All that would be split if their children gained nothing; opening more than are split at last changes no choice.
        fresh = [n for _, n in heapq.nsmallest(shape.leaves - leaves, heap) if nodes[n][3] is None]
        few = np.full(len(nodes), -1)
        for i, n in enumerate(fresh):
            hist, depth, (_, feature, limit, missing), _ = nodes[n]
            goes = hist[feature, 1 : limit + 1, 1].sum() + (hist[feature, 0, 1] if missing else 0)
            left_small = goes * 2 <= hist[feature, :, 1].sum()
            own = np.flatnonzero(at == n)
            to_left = goes_left(bins[own, feature], limit, missing)
            nodes[n][3] = (len(nodes), len(nodes) + 1, left_small)
            at[own] = np.where(to_left, len(nodes), len(nodes) + 1)
            nodes += [[None, depth + 1, None, None], [None, depth + 1, None, None]]
            few = np.append(few, [i, -1] if left_small else [-1, i])
        if fresh:
            own = np.flatnonzero(few[at] >= 0)
            counted = yield _histograms(bins[own], g[own], few[at[own]], len(fresh))
            for i, n in enumerate(fresh):
                left, right, left_small = nodes[n][3]
                small, large = (left, right) if left_small else (right, left)
                nodes[small][0], nodes[large][0] = counted[i], nodes[n][0] - counted[i]
            born = [c for n in fresh for c in nodes[n][3][:2]]
            # Too deep or too small to be split: not looked at.
            able = [c for c in born if nodes[c][1] < shape.depth and nodes[c][0][0, :, 1].sum() >= 2 * shape.least]
            for c in born:
                nodes[c][2] = (0.0, 0, 0, False)
            for c, found in zip(able, best_splits(np.stack([nodes[c][0] for c in able]), columns, shape) if able else [], strict=True):
                nodes[c][2] = found
        while heap and leaves < shape.leaves and nodes[heap[0][1]][3] is not None:
            n = heapq.heappop(heap)[1]
            split.add(n)
            leaves += 1
            for child in nodes[n][3][:2]:
                if nodes[child][2][0] > 1e-12:
                    heapq.heappush(heap, (-nodes[child][2][0], child))
    kept, out = [0], {f: [] for f in FIELDS}
    for n in kept:  # grows while it is read: children follow their parents
        hist, _, (_, feature, limit, missing), children = nodes[n]
        inner = n in split
        out["feature"].append(feature if inner else -1)
        out["limit"].append(limit if inner else 0)
        out["missing_left"].append(missing and inner)
        out["left"].append(len(kept) if inner else -1)
        out["right"].append(len(kept) + 1 if inner else -1)
        out["value"].append(0.0)
        out["cover"].append(float(hist[0, :, 1].sum()))
        if inner:
            kept += children[:2]
    return {f: np.array(v, {"feature": np.int32, "limit": np.int32, "missing_left": bool, "left": np.int32, "right": np.int32}.get(f, float)) for f, v in out.items()}


def score(trees: list[dict[str, np.ndarray]], bins: np.ndarray, start: float, rate: float) -> np.ndarray:
    out = np.full(len(bins), start)
    for tree in trees:
        out += rate * tree["value"][place(tree, bins)]
    return out


def boost(bins: np.ndarray, y: np.ndarray, key: np.ndarray, level: float, shape: Shape, start: float | None = None, trees: list | None = None, upto: int | None = None) -> Generator[np.ndarray, np.ndarray, tuple[float, list]]:
    """(start, trees) for one level, going on from given trees. Every task has its own rows and makes the same model.

    This and what it calls yield an array and go on with its sum over the tasks (see ``gather.drive``).
    """
    trees = list(trees or [])
    if start is None:
        start = float((yield from quantiles(y, np.zeros(len(y), np.int64), 1, level))[0])
    now = score(trees, bins, start, shape.rate)
    features = bins.shape[1]
    for step in range(len(trees), shape.trees if upto is None else upto):
        rng = np.random.default_rng([shape.seed, step, round(level * 1000)])
        columns = np.sort(rng.permutation(features)[: max(1, round(features * shape.columns))])
        own = np.flatnonzero(mixed(key, shape.seed + step) < np.uint64(min(int(shape.rows * 2.0**64), (1 << 64) - 1)))
        g = np.where(y[own] > now[own], -level, 1.0 - level)
        tree = yield from grow(bins[own], g, columns, shape)
        leaf = place(tree, bins)
        held = np.flatnonzero(tree["feature"] < 0)
        where = np.zeros(len(tree["feature"]), np.int64)
        where[held] = np.arange(len(held))
        tree["value"][held] = yield from quantiles(y[own] - now[own], where[leaf[own]], len(held), level)
        now += shape.rate * tree["value"][leaf]
        trees.append(tree)
    return start, trees


@lru_cache(maxsize=64)
def _weights(d: int) -> np.ndarray:
    return np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])


def _leaf_paths(tree: dict[str, np.ndarray]) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
    """(leaf, [(node, to the left)]) of every leaf."""
    todo: list[tuple[int, list]] = [(0, [])]
    while todo:
        n, path = todo.pop()
        if tree["feature"][n] < 0:
            yield n, path
        else:
            todo += [(int(tree["left"][n]), [*path, (n, True)]), (int(tree["right"][n]), [*path, (n, False)])]


def shapley(trees: list[dict[str, np.ndarray]], bins: np.ndarray, start: float, rate: float) -> tuple[float, np.ndarray]:
    """(base, values by row and feature): exact Shapley values of the game in which an absent feature's splits are averaged by the rows on either side.

    The base and a row's values add up to its prediction. A leaf's path asks a few features; whether a row meets each one's conditions makes a
    pattern, and the values of a leaf depend on the pattern alone, so they are worked out once for all patterns and looked up for rows.
    """
    base, out = start, np.zeros(bins.shape)
    for tree in trees:
        share = np.maximum(tree["cover"], 1e-300)
        for leaf, path in _leaf_paths(tree):
            value = rate * tree["value"][leaf]
            names: dict[int, int] = {}
            zero: list[float] = []
            met: list[np.ndarray] = []
            for n, left in path:
                f = int(tree["feature"][n])
                passed = goes_left(bins[:, f], tree["limit"][n], tree["missing_left"][n]) == left
                part = share[tree["left" if left else "right"][n]] / share[n]
                if f in names:
                    zero[names[f]] *= part
                    met[names[f]] &= passed
                else:
                    names[f] = len(zero)
                    zero.append(part)
                    met.append(passed)
            base += value * float(np.prod(zero))
            d = len(zero)
            if not d or value == 0:
                continue
            patterns = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
            table = np.empty((1 << d, d))
            for i in range(d):
                # Coefficients of the product of (zero + pattern * t) over the other features: subsets by size.
                poly = np.zeros((1 << d, d))
                poly[:, 0] = 1
                for j in range(d):
                    if j != i:
                        poly[:, 1:], poly[:, 0] = poly[:, 1:] * zero[j] + poly[:, :-1] * patterns[:, j : j + 1], poly[:, 0] * zero[j]
                table[:, i] = value * (patterns[:, i] - zero[i]) * (poly @ _weights(d))
            which = sum(m.astype(np.int64) << i for i, m in enumerate(met))
            out[:, list(names)] += table[which]
    return base, out


class QuantileTrees:
    """Quantiles as sums of trees: for each level a start and trees as flat arrays. Calls add ``lo``, ``pred`` and ``hi``, kept in order."""

    def __init__(self, features: list[str], cuts: list[np.ndarray], levels: tuple[float, ...], starts: list[float], trees: list[list], rate: float):
        self.features, self.cuts, self.levels, self.starts, self.trees, self.rate = features, cuts, levels, starts, trees, rate

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        return np.stack([score(t, bins, s, self.rate) for t, s in zip(self.trees, self.starts, strict=True)], 1)

    def __call__(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("lo double, pred double, hi double")
        def predicted(frame: pd.DataFrame) -> pd.DataFrame:
            q = np.sort(model.raw(frame.to_numpy(float, na_value=np.nan)), 1)
            return pd.DataFrame({"lo": q[:, 0], "pred": q[:, q.shape[1] // 2], "hi": q[:, -1]})

        out = df.withColumn("_q", predicted(F.struct(*[F.col(f).cast("double") for f in self.features])))
        return out.withColumns({c: F.col(f"_q.{c}") for c in ("lo", "pred", "hi")}).drop("_q")

    def attribute(self, df: DataFrame, level: float = 0.5) -> DataFrame:
        """``df`` with ``pred`` (the level's prediction), ``base`` and ``by_{feature}``: Shapley values that add up to ``pred`` - ``base``."""
        at, names = self.levels.index(level), [f"by_{f}" for f in self.features]
        cuts, start, trees, rate = self.cuts, self.starts[at], self.trees[at], self.rate

        @F.pandas_udf(", ".join(f"`{c}` double" for c in ("pred", "base", *names)))
        def explained(frame: pd.DataFrame) -> pd.DataFrame:
            bins = binned(frame.to_numpy(float, na_value=np.nan), cuts)
            base, values = shapley(trees, bins, start, rate)
            return pd.DataFrame(np.column_stack([score(trees, bins, start, rate), np.full(len(bins), base), values]), columns=["pred", "base", *names])

        out = df.withColumn("_e", explained(F.struct(*[F.col(f).cast("double") for f in self.features])))
        return out.withColumns({c: F.col(f"_e.`{c}`") for c in ("pred", "base", *names)}).drop("_e")

    def gains(self) -> dict[str, float]:
        """How often each feature is asked, weighted by the rows that it is asked for, over all levels; in all 1."""
        total = np.zeros(len(self.features))
        for trees in self.trees:
            for t in trees:
                inner = t["feature"] >= 0
                np.add.at(total, t["feature"][inner], t["cover"][inner])
        return dict(zip(self.features, (total / (total.sum() or 1.0)).tolist(), strict=True))

    def packed(self) -> bytes:
        held = {"levels": np.array(self.levels), "starts": np.array(self.starts), "rate": np.array(self.rate), "sizes": np.array([[len(t["feature"]) for t in ts] for ts in self.trees], np.int64).reshape(len(self.levels), -1)}
        held |= {f: np.concatenate([t[f] for ts in self.trees for t in ts]) if any(self.trees) else np.zeros(0) for f in FIELDS}
        held |= {f"cuts{i}": c for i, c in enumerate(self.cuts)}
        out = io.BytesIO()
        np.savez_compressed(out, **held)
        return out.getvalue()

    @staticmethod
    def unpacked(features: list[str], data: bytes) -> QuantileTrees:
        held = np.load(io.BytesIO(data))
        sizes, at, trees = held["sizes"], 0, []
        kinds = {f: held[f] for f in FIELDS}
        for own in sizes:
            trees.append([])
            for n in own.tolist():
                trees[-1].append({f: kinds[f][at : at + n] for f in FIELDS})
                at += n
        return QuantileTrees(features, [held[f"cuts{i}"] for i in range(len(features))], tuple(held["levels"].tolist()), held["starts"].tolist(), trees, float(held["rate"]))

    def save(self, path: str) -> None:
        """One row: the names of the features and the packed arrays."""
        spark = SparkSession.active()
        spark.createDataFrame([(self.features, bytearray(self.packed()))], "features array<string>, model binary").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> QuantileTrees:
        row = SparkSession.active().read.parquet(path).first()
        return QuantileTrees.unpacked(list(row["features"]), bytes(row["model"]))


def feature_cuts(df: DataFrame, features: list[str], bins: int = BINS, error: float = 0.001) -> list[np.ndarray]:
    """At most ``bins`` - 1 cuts of each feature, at its quantiles."""
    found = df.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(features, [i / bins for i in range(1, bins)], error)
    return [np.unique(np.array(c, float)[~np.isnan(c)]) for c in found]


def binned_rows(rows: DataFrame, features: list[str], target: str, cuts: list[np.ndarray]) -> DataFrame:
    """(bins, y, key): a byte for each feature, the target, and a hash of the row; written once, as each stage reads it anew."""

    def packed_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            raw = binned(x, cuts).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + len(features)] for i in range(0, len(raw), len(features))], pa.binary()), batch.column(len(features)), batch.column(len(features) + 1)], ["bins", "y", "key"])

    own = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    goal = F.col(target).cast("double")
    return cut(rows.select(*own, goal.alias("y"), F.xxhash64(*[F.col(f).cast("double") for f in features], goal).alias("key")).mapInArrow(packed_bins, "bins binary, y double, key long"))


def row_arrays(tab: pa.Table, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, targets and hashes of a task's rows."""
    return np.frombuffer(b"".join(tab["bins"].to_pylist()), np.uint8).reshape(-1, features), tab["y"].to_numpy(), tab["key"].to_numpy().view(np.uint64)


def fit_quantiles(train: DataFrame, features: list[str], target: str, levels: tuple[float, ...], shape: Shape, per_task: int, per_round: int) -> QuantileTrees:
    rows = train.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    cuts = feature_cuts(rows, features)
    dealt, parts = spread(binned_rows(rows, features, target, cuts), per_task)

    def learned(levels: tuple[float, ...]) -> QuantileTrees:
        model = QuantileTrees(list(features), cuts, levels, [None] * len(levels), [[] for _ in levels], shape.rate)
        for upto in [*range(per_round, shape.trees, per_round), shape.trees]:
            before, starts = model.trees, model.starts

            def work(tab: pa.Table, summed: Sum, task: int, upto=upto, before=before, starts=starts) -> bytes | None:
                bins, y, key = row_arrays(tab, len(features))
                made = drive([boost(bins, y, key, level, shape, starts[k], before[k], upto) for k, level in enumerate(levels)], summed, parts == 1)
                return QuantileTrees(list(features), cuts, levels, [m[0] for m in made], [m[1] for m in made], shape.rate).packed() if task == 0 else None

            model = QuantileTrees.unpacked(list(features), in_tasks(dealt, parts, work))
        return model

    if parts > 1:
        return learned(tuple(levels))
    # Rows that one task holds: the levels have nothing to exchange and are learned side by side.
    models = at_once([lambda level=level: learned((level,)) for level in levels])
    return QuantileTrees(list(features), cuts, tuple(levels), [m.starts[0] for m in models], [m.trees[0] for m in models], shape.rate)
