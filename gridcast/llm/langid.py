"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (letters lower-cased, other characters as
word boundaries), and a linear softmax maps the average to languages. Both matrices are trained by mini-batch
stochastic gradient descent in numpy on a bounded sample of labelled rows (``SAMPLE`` rows at most in expectation per language and about ``TOTAL`` in all, drawn by a hash of the id and the text, and every language that occurs is learned); features are counted on the executors, so no text reaches the driver. A temperature fitted on a
held-back part of the sample calibrates the probabilities, and the rejection threshold is the lowest calibrated
probability at which predictions of that part are still right nine times in ten.

As the model is linear behind the average, scoring adds one row of class scores per n-gram: each batch is a
vectorised gather over all bytes of whole texts, cut into slices of bounded size.

Results: null texts and texts without a letter get ``und`` with score 0. With no labelled row at all, everything is
``und``. Very long texts are read whole; ties go to the first language in name order; an empty table gives an empty result. Labels, sources
and ids are never inputs of a prediction. Other columns are not read, whatever their names. The model has a column of ``BUCKETS`` scores for each
language that occurs among the rows to learn from, however rare it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, uniform

BUCKETS = 1 << 13
DIM = 16
GRAMS = (2, 3, 4)
SAMPLE = 1200
TOTAL = 12_000
LEAST = 20
EPOCHS = 40
SLICE = 1 << 20


_TABLE = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower case, with spaces for what is not a letter (by Unicode category) and at both ends."""
    low = text.lower()
    if low.isascii():
        return b" " + low.encode().translate(_TABLE).strip() + b" "
    low = _OTHER.sub(" ", low)
    if not low.replace(" ", "").isalpha():  # numerals that are no digits are word characters too
        low = "".join(c if c.isalpha() else " " for c in low)
    return b" " + low.encode("utf-8", "surrogatepass").strip() + b" "


def grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets) of all byte n-grams of each length."""
    wide = data.astype(np.uint32)
    code = wide
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ wide[n - 1 :]
        if n in GRAMS:
            mixed = code * np.uint32(0x9E3779B1)
            yield n, (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text and their shares."""
    data = np.frombuffer(normal(text), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), SLICE):
        for n, found in grams(data[at : at + SLICE + max(GRAMS) - 1]):
            total += np.bincount(found[: min(len(found), SLICE)], minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, (total[used] / max(1, total.sum())).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, calibrated probability) of each text; ``und`` and 0 without a letter."""
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        part, size, where = [], 0, []
        logits = np.zeros((len(texts), len(self.langs)))
        counts = np.zeros(len(texts))

        def flush():
            if not part:
                return
            data = np.frombuffer(b"".join(part), np.uint8)
            ends = np.cumsum([len(p) for p in part])
            starts = ends - [len(p) for p in part]
            for n, found in grams(data):
                # Grams that cross into the next text lie between a text's last and the next one's first.
                cuts = np.stack((starts, ends - n + 1), 1).ravel()
                sums = np.stack([np.add.reduceat(np.concatenate((np.take(c, found), [0.0])), cuts)[::2] for c in self.scores.T], 1)
                np.add.at(logits, where, sums)
                np.add.at(counts, where, ends - n + 1 - starts)
            part.clear()
            where.clear()

        for i, text in enumerate(texts):
            data = normal(text or "")
            if data.isspace() or not self.langs:
                continue
            langs[i] = ""
            for at in range(0, len(data) - 2, SLICE):
                piece = data[at : at + SLICE + max(GRAMS) - 1]
                piece = piece if len(piece) >= max(GRAMS) + 1 else piece + b" " * (max(GRAMS) + 1 - len(piece))
                part.append(piece)
                where.append(i)
                size += len(piece)
                if size > SLICE:
                    flush()
                    size = 0
        flush()
        live = [i for i, x in enumerate(langs) if x == ""]
        if live:
            z = (logits[live] / np.maximum(counts[live], 1)[:, None] + self.bias) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i, k, s in zip(live, best.tolist(), p[np.arange(len(live)), best].tolist(), strict=True):
                langs[i], score[i] = self.langs[k], s
        return langs, score


def fit(rows: list[tuple[list[int], list[float], str]], seed: int = 0, epochs: int = EPOCHS, dim: int = DIM) -> Model:
    """Train on (buckets, shares, language) rows."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    place = {lang: i for i, lang in enumerate(langs)}
    y = np.array([place[r[2]] for r in rows])

    def dense(own: np.ndarray) -> np.ndarray:
        x = np.zeros((len(own), BUCKETS), np.float32)
        for at, i in enumerate(own.tolist()):
            x[at, rows[i][0]] = rows[i][1]
        return x

    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    train = order[len(rows) // 5 :] if len(rows) >= 50 else order
    embed = rng.normal(0, 1, (BUCKETS, dim)).astype(np.float32)
    weight, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    batch = 64
    for epoch in range(epochs):
        rate = np.float32(2.0 * (1 - epoch / epochs))
        for at in range(0, len(train), batch):
            own = train[at : at + batch]
            x = dense(own)
            h = x @ embed
            z = h @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            g = p / len(own)
            back = g @ weight.T
            weight -= rate * (h.T @ g)
            bias -= rate * 0.1 * g.sum(0)
            embed -= rate * 20 * (x.T @ back)
        train = rng.permutation(train)
    scores = (embed @ weight).astype(np.float64)
    z = np.concatenate([dense(held[at : at + 512]) @ scores for at in range(0, len(held), 512)]) + bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), y[held]]).mean())

    temperature = min(np.geomspace(0.05, 20, 80).tolist(), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top, right = p.max(1), p.argmax(1) == y[held]
    by = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= 0.9)
    return Model(langs, scores, bias.astype(np.float64), temperature, float(top[by[good[-1]]]) if len(good) else 1.0)


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``sample`` rows a language of ``docs``, which holds the rows to learn from; on fewer, ``LEAST`` at the least, where ``TOTAL`` rows would be passed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # every language is learned
    if not sizes:
        return fit([])
    sample = min(sample, max(LEAST, TOTAL // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    drawn = rows.withColumn("_u", uniform(seed, "doc_id", F.xxhash64("text").cast("string"))).filter(F.col("_u") < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_grams(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float32())), batch.column(1), batch.column(2)], ["used", "share", "lang", "u"])

    # `u` is uniform on [0, 1) and cut at sample / n, so a language has `sample` rows, give or take a few standard deviations.
    got = drawn.select("text", "lang", "_u").mapInArrow(count, "used array<int>, share array<float>, lang string, u double").toArrow()
    rows_ = sorted(zip(got["u"].to_pylist(), got["lang"].to_pylist(), got["used"].to_numpy(), got["share"].to_numpy(), strict=True), key=lambda r: r[:2])
    return fit([(u, s, lang) for _, lang, u, s in rows_], seed)


def identify(docs: DataFrame, model: Model, min_score: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected (calibrated score under the threshold) for every row.

    With ``min_score`` predictions of a lower score become ``und``.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # BUCKETS x languages doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                langs, score = own.predict(part.column(1).to_pylist())
                low = [x == "und" or s < own.threshold for x, s in zip(langs, score, strict=True)]
                if min_score is not None:
                    langs = ["und" if s < min_score else x for x, s in zip(langs, score, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(low)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def remainder(mod: int, id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those with crc32(doc_id) mod 5 other than 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(remainder(5) != 0))
    return identify(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
