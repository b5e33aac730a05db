"""Hard-negative mining by distributed radix selection over integer scores.

Components become integers, floor(256 * x), so scores (inner products with an anchor) are exact integers and have digits. A window is an anchor with a range of
scores and a rule for labels: first one window an anchor for its positives, then one for each anchor and positive for the negatives. To find a
window's k-th best score, every task counts its rows into the buckets of the leading digit; the counts are summed by (window, bucket), the bucket
that holds the k-th row is opened and its rows are counted by the next digit, and so on to the score itself. Only rows above that score, and each
task's smallest ids among those equal to it, are gathered, and ranked by score and id.

Anchors come in blocks (``BLOCK`` in expectation, by hash), one after another; a block's vectors and windows are broadcast, its counts (windows x ``BUCKETS``
at most) come to the driver, and its results are appended to one table. All rows are held against each block, in Arrow batches.

Results: rows with a null id, label or vector, or a null or non-finite component take no part. Rows equal in id, label and vector count once; rows that share only
the id are rows of their own, but never each other's positives. Ties go to the smaller id, then to the smaller label. Vectors of different lengths have no score with each other; empty vectors
score 0. A label with one row has no positives; windows with under k rows give all they have. Scores of 2^61 or more raise an error. Vectors may be of any length. An empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch, table

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
SCALE = 256
BLOCK = 512
DIGIT = 7
BUCKETS = 1 << DIGIT
EXACT = float(1 << 53)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v): the rows that take part, once each, with integer components as doubles."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(sound).select("id", "label", F.transform("x", _floor).alias("v")).distinct()


def _floor(c: F.Column) -> F.Column:
    """floor(256 * c) as a double; from 2^52 on doubles are whole."""
    return F.when(F.abs(c) < float(1 << 44), F.floor(c * SCALE).cast("double")).otherwise(c * SCALE)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of x with all rows of y; in doubles where no sum can exceed 2^53."""
    if not x.size or not y.size or float(np.abs(x).sum(1).max()) * float(np.abs(y).max()) < EXACT:
        return (x @ y.T).astype(np.int64)
    exact = np.array([[int(c) for c in r] for r in x], object) @ np.array([[int(c) for c in r] for r in y], object).T
    if max(abs(int(exact.max())), abs(int(exact.min()))) >= 1 << 61:
        raise OverflowError("a score is 2^61 or more")
    return exact.astype(np.int64)


class Windows:
    """Windows of a block of anchors, as arrays: anchor (its place), lo and hi (scores), same (label rule), k; and where selection has come to.

    Offsets count down from ``hi``. ``base`` is where the bucket begins that holds the k-th row, ``need`` the rows still to find in it; ``open`` windows are
    not settled. At the end offsets under ``base`` qualify, and ``need`` rows at ``base``; a window with too few rows has its base beyond its range.
    """

    def __init__(self, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int):
        self.anchor, self.lo, self.hi, self.same = anchor, lo, hi, same
        self.width = np.maximum(hi - lo + 1, 0)
        self.base, self.need = np.zeros(len(lo), np.int64), np.full(len(lo), k, np.int64)
        self.open = self.width > 0
        bits = max(1, int(self.width.max(initial=1) - 1).bit_length())
        self.digits = -(-bits // DIGIT)
        self.step = -(-bits // self.digits)

    def refine(self, window: np.ndarray, bucket: np.ndarray, count: np.ndarray, shift: int) -> None:
        """Open the bucket that holds the k-th row of each window. The counts come in any order."""
        table_ = np.zeros((len(self.lo), 1 << self.step), np.int64)
        table_[window, bucket] = count
        upto = table_.cumsum(1)
        short = self.open & (upto[:, -1] < self.need)
        self.base[short], self.need[short] = self.width[short], 0
        self.open &= ~short
        own = np.flatnonzero(self.open)
        at = (upto[own] >= self.need[own, None]).argmax(1)
        self.need[own] -= upto[own, at] - table_[own, at]
        self.base[own] += at.astype(np.int64) << shift


def _batches(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, places of the anchors, scores, equal labels) of each batch and vector length, rows by id."""
    for batch in batches:
        v = batch.column(2)
        size = pc.list_value_length(v).to_numpy()
        for dim in np.unique(size).tolist():
            own = block["dims"].get(dim)
            if own is None:
                continue
            rows = np.flatnonzero(size == dim)
            ids = batch.column(0).to_numpy()[rows]
            rows = rows[np.lexsort((batch.column(1).to_numpy()[rows], ids))]
            x = v.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)
            ids, labels = batch.column(0).to_numpy()[rows], batch.column(1).to_numpy()[rows]
            yield ids, labels, own, scores(x, block["vectors"][dim]), labels[:, None] == block["label"][own][None, :]


def _eligible(ids: np.ndarray, own: np.ndarray, equal: np.ndarray, block: dict, same: bool) -> np.ndarray:
    return equal & (ids[:, None] != block["id"][own][None, :]) if same else ~equal


def _lanes(windows: Windows, anchors: int) -> list[np.ndarray]:
    """Windows dealt to lanes with one window an anchor at most: for each lane the window of each anchor, or -1."""
    nth = np.zeros(len(windows.anchor), np.int64)
    seen = np.zeros(anchors, np.int64)
    for i, a in enumerate(windows.anchor.tolist()):
        nth[i] = seen[a]
        seen[a] += 1
    lanes = [np.full(anchors, -1) for _ in range(int(seen.max(initial=0)))]
    for i, (a, n) in enumerate(zip(windows.anchor.tolist(), nth.tolist(), strict=True)):
        lanes[n][a] = i
    return lanes


def select(rows: DataFrame, block: dict, windows: Windows) -> DataFrame:
    """(window, id, label, score) of the rows that qualify; ties at the last place may bring more, at most ``need`` a task and window."""
    spark = rows.sparkSession
    lanes = _lanes(windows, len(block["id"]))
    for digit in range(windows.digits):
        shift = (windows.digits - 1 - digit) * windows.step
        sent = spark.sparkContext.broadcast((block, windows, lanes))

        def count(batches: Iterator[pa.RecordBatch], sent=sent, shift=shift) -> Iterator[pa.RecordBatch]:
            block, windows, lanes = sent.value
            total = np.zeros(len(windows.lo) << windows.step, np.int64)
            for ids, _, own, score, equal in _batches(batches, block):
                fit = _eligible(ids, own, equal, block, windows.same)
                for lane in lanes:
                    w = lane[own]
                    some = np.flatnonzero((w >= 0) & windows.open[w])
                    w = w[some]
                    bucket = windows.hi[w] - windows.base[w] - score[:, some]
                    end = np.minimum(min(1 << shift + windows.step, (1 << 63) - 1), windows.width[w] - windows.base[w])
                    i, j = np.nonzero(fit[:, some] & (bucket >= 0) & (bucket < end))
                    total += np.bincount((w[j] << windows.step) + (bucket[i, j] >> shift), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array((at >> windows.step).astype(np.int32)), pa.array((at & (1 << windows.step) - 1).astype(np.int32)), pa.array(total[at])], ["window", "bucket", "n"])

        # At most a row for each window of the block and bucket.
        found = rows.mapInArrow(count, "window int, bucket int, n long").groupBy("window", "bucket").agg(F.sum("n").alias("n")).toArrow()
        windows.refine(found["window"].to_numpy(), found["bucket"].to_numpy(), found["n"].to_numpy(), shift)
        sent.unpersist()
    sent = spark.sparkContext.broadcast((block, windows, lanes))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows, lanes = sent.value
        names = ["window", "id", "label", "score"]

        def out(w, ids, labels, score):
            return pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(ids), pa.array(labels), pa.array(score)], names)

        ties = [np.zeros(0, np.int64) for _ in range(4)]
        for ids, labels, own, score, equal in _batches(batches, block):
            fit = _eligible(ids, own, equal, block, windows.same)
            for lane in lanes:
                some = np.flatnonzero(lane[own] >= 0)
                w = lane[own][some]
                s = score[:, some]
                offset = windows.hi[w] - s
                own_fit = fit[:, some] & (offset >= 0) & (offset < windows.width[w])
                i, j = np.nonzero(own_fit & (offset < windows.base[w]))
                if len(i):
                    yield out(w[j], ids[i], labels[i], s[i, j])
                last = own_fit & (offset == windows.base[w])
                if last.any():
                    last &= last.cumsum(0) <= windows.need[w]  # rows stand by id
                    i, j = np.nonzero(last)
                    ties = [np.concatenate(p) for p in zip(ties, (w[j], ids[i], labels[i], s[i, j]), strict=True)]
            if len(ties[0]) > 1 << 16:
                ties = _first(ties, windows.need)
        ties = _first(ties, windows.need)
        if len(ties[0]):
            yield out(*ties)

    return rows.mapInArrow(gather, "window int, id long, label long, score long")


def _first(ties: list[np.ndarray], need: np.ndarray) -> list[np.ndarray]:
    """The first rows of each window by id and label, as many as it needs."""
    order = np.lexsort((ties[2], ties[1], ties[0]))
    w = ties[0][order]
    place = np.arange(len(w)) - np.searchsorted(w, w)
    return [t[order[place < need[w]]] for t in ties]


def best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each window, with their rank."""
    order = Window.partitionBy("window").orderBy(F.desc("score"), "id", "label")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def block_of(found: pa.Table) -> dict:
    """A block of anchors: id, label, and by vector length the places and vectors."""
    size = pc.list_value_length(found["v"]).to_numpy()
    dims = {d: np.flatnonzero(size == d) for d in np.unique(size).tolist()}
    return {"id": found["id"].to_numpy(), "label": found["label"].to_numpy(), "dims": dims, "vectors": {d: np.array([found["v"][i].as_py() for i in own.tolist()], np.float64).reshape(len(own), d) for d, own in dims.items()}}


def mine(vectors: DataFrame, anchors: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """For every anchor (rows for which the condition on the column ``id`` holds) and each of its best ``positives`` rows of the same label the best
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    rows = materialize(prepared(vectors, id_col, vec_col, label_col), "vectors")
    chosen = rows.filter(anchors)
    blocks = -(-chosen.count() // block)
    if not blocks:
        return spark.createDataFrame([], RESULT)
    dealt = scratch(spark, "anchors")
    chosen.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(dealt)
    dealt = spark.read.schema("id long, label long, v array<double>, block int").parquet(dealt)
    norm = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + F.abs(c)))).first()[0] or 0.0)
    path = scratch(spark, "hard-negatives")
    for b in range(blocks):
        own = block_of(dealt.filter(F.col("block") == b).select("id", "label", "v").toArrow())
        if not len(own["id"]):
            continue
        # No score of an anchor is beyond its largest component times the largest sum of components.
        top = np.zeros(len(own["id"]), np.int64)
        for dim, at in own["dims"].items():
            top[at] = [min(int(norm * float(np.abs(v).max(initial=0))) + 1, 1 << 61) for v in own["vectors"][dim]]
        first = best(select(rows, own, Windows(np.arange(len(top)), -top, top, True, positives)), positives).select("window", "rank", "id", "score").toArrow()
        order = np.lexsort((first["rank"].to_numpy(), first["window"].to_numpy()))
        anchor, other, score = (first[c].to_numpy()[order].astype(np.int64) for c in ("window", "id", "score"))
        below = np.array([-(-low * int(s) // 100) for s in score], np.int64)
        above = np.array([high * int(s) // 100 for s in score], np.int64)
        found = best(select(rows, own, Windows(anchor, below, above, False, negatives)), negatives)
        pairs = spark.createDataFrame(pa.table({"window": pa.array(np.arange(len(anchor)), pa.int32()), "anchor_id": own["id"][anchor], "positive_id": other, "positive_score": score}), "window int, anchor_id long, positive_id long, positive_score long")
        named = found.join(F.broadcast(pairs), "window")  # a row for each window of the block
        named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors of the embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM q a JOIN q r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
