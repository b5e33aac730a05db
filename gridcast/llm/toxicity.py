"""Toxic spans by a linear-chain conditional random field over words, aggregated to document scores.

Labels say which documents are toxic, not which words, so the training tokens are labelled first: among the word
and affix features of a bounded sample, those whose presence marks toxic documents and hardly any other are chosen if
too frequent for chance, or greedily until they cover the toxic documents they can; a word of a toxic document with such a feature is a toxic
token, every word of a clean document is not. A two-state chain (other, toxic) is then trained on these
sequences by gradient descent on the exact likelihood: emissions of word, prefix and suffix features, and transitions.

Forward-backward marginals of the words give spans (marginal of a half or more, with character offsets) and
the document's chance of any toxic word; that and the toxic share are calibrated to a score by a
logistic fit on the sample. Words without any feature share one emission, so a run of them is one matrix power: chains are
evaluated over the words with evidence alone, exactly as over the whole text.

The sample stays on the executors: texts are read there in every step of the training, and the driver gets what follows from them, namely three
sketch hashes of a text, the pure features, the places of words with a feature of the model, and two numbers of a text for the calibration. It holds
``SAMPLE`` texts of each label in expectation (equal texts once), drawn by a hash of the id and the text.

Results: null and empty texts score as a text without evidence. Without labels of both kinds every score is 0. Very long
texts are read whole. Ties and repeated rows score alike. An empty table gives an empty result. ``filter_toxic`` keeps all columns, whatever their
names; ``score`` reads the id and the text only. Labels, languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, uniform
from .langid import remainder

SAMPLE = 3000
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
AFFIXES = (3, 4, 5, 6)
SUFFIXES = (4,)
MAX_WORDS = 500_000
#: Seeds must be this pure on the sample: clean documents over toxic ones, both as shares of their kind.
IMPURE = 0.02
LEAST = 3
SURE = 14
CAP = 64  # words of a training chain
STEPS = 150  # of gradient descent
QUIET = 0.05  # how much a training chain without a feature counts: it holds no toxic word, and there are very many


def features(word: str) -> list[str]:
    """Of one lower-case word: itself and its affixes."""
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in AFFIXES if n > k), *("$" + word[-k:] for k in SUFFIXES if n > k)]


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)  # of a feature, for the state toxic
    bias: float = -6.0  # toxic, on every word
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # other-other, other-toxic, toxic-other, toxic-toxic
    calib: tuple[float, float, float] = (-20.0, 0.0, 0.0)  # bias, chance, log number of toxic words
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def evidence(self, text: str) -> tuple[list[float], list[int], int]:
        """The emissions of words with a feature, their places, and the number of words."""
        words = words_of(text)
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            if len(known) > MAX_WORDS:
                known.clear()
            weight = self.weight
            for w in set(words):
                if w not in known:
                    known[w] = sum(weight.get(f, 0.0) for f in features(w))
            got = list(map(known.__getitem__, words))
        if not any(got):
            return [], [], len(words)
        at = [i for i, x in enumerate(got) if x]
        return [got[i] for i in at], at, len(words)

    def marginals(self, emit: list[float], at: list[int], n: int) -> np.ndarray:
        """The chance of the state toxic at each place with evidence, by forward-backward over the whole chain."""
        a = np.exp(np.array(self.trans).reshape(2, 2))
        step = a * np.array([1.0, np.exp(self.bias)])  # a word without evidence
        start = np.array([1.0, np.exp(self.bias)])

        def run(k: int) -> np.ndarray:
            out, base = np.eye(2), step / step.max()
            while k:
                if k & 1:
                    out = out @ base
                    out /= out.max()
                base = base @ base
                base /= base.max()
                k >>= 1
            return out

        forward, last = [], -1
        f = None
        for e, i in zip(emit, at, strict=True):
            if f is None:
                f = start.copy() if i == 0 else start @ run(i - 1) @ step if i > 1 else start @ step
                if i == 0:
                    f = start
            else:
                f = f @ run(i - last - 1) @ step
            f = f * np.array([1.0, np.exp(min(50.0, e))])
            f = f / f.sum()
            forward.append(f)
            last = i
        b = run(n - 1 - last) @ np.ones(2)
        out = np.zeros(len(at))
        for k in range(len(at) - 1, -1, -1):
            m = forward[k] * b
            out[k] = m[1] / m.sum()
            if k:
                b = run(at[k] - at[k - 1] - 1) @ step @ (np.array([1.0, np.exp(min(50.0, emit[k]))]) * b)
                b /= b.max()
        return out

    def aggregate(self, marginal: np.ndarray) -> tuple[float, float]:
        """The chance of any toxic word, and the logarithm of one plus their expected number."""
        return 1.0 - float(np.prod(1.0 - marginal)), float(np.log1p(marginal.sum()))

    def score(self, text: str | None) -> tuple[float, list[int], np.ndarray]:
        emit, at, n = self.evidence(text or "")
        marginal = self.marginals(emit, at, n) if at else np.zeros(0)
        chance, amount = self.aggregate(marginal)
        z = self.calib[0] + self.calib[1] * chance + self.calib[2] * amount
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), at, marginal

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Character offsets of maximal runs of words whose marginal is a half or more."""
        _, at, marginal = self.score(text)
        toxic = {i for i, m in zip(at, marginal, strict=True) if m >= 0.5}
        out: list[tuple[int, int]] = []
        last = -2
        if toxic:
            low = text.lower()
            same = len(low) == len(text)
            for i, m in enumerate(WORD.finditer(low if same else text)):
                if i in toxic:
                    out[-1:] = [(out[-1][0], m.end())] if last == i - 1 and out else [*out[-1:], (m.start(), m.end())]
                    last = i
        return out


#: Features are counted in so many hashed buckets, which bounds the driver's memory.
BUCKETS = 1 << 22


@lru_cache(100_000)
def _buckets(word: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(f.encode()) & (BUCKETS - 1) for f in features(word))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def sketch(text: str, words: int = 5, sketches: int = 3) -> list[int]:
    """The smallest of so many mixes of the hashes of the text's shingles."""
    found = np.array([zlib.crc32(w.encode()) for w in words_of(text)], np.uint64)
    found = np.concatenate((found, np.zeros(max(0, words - len(found)), np.uint64)))
    joined = found[: len(found) - words + 1].copy()
    for k in range(1, words):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + found[k : len(found) - words + 1 + k]
    joined ^= joined >> np.uint64(29)
    return [int((joined * np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) >> np.uint64(1)).min()) for k in range(sketches)]


def first_of_copies(rows: list[tuple[int, list[int]]]) -> set[int]:
    """The keys of (key, sketches) rows without later copies and near copies, which share a sketch: these make chance words look frequent."""
    seen: set[tuple[int, int]] = set()
    out = set()
    for key, own in rows:
        named = set(enumerate(own))
        if named.isdisjoint(seen):
            out.add(key)
        seen |= named
    return out


def chosen_seeds(pure: list[list[str]]) -> set[str]:
    """Features that mark toxic texts, given the pure ones of each: those too frequent for chance, and others greedily until each text has two it can have."""
    having: dict[str, list[int]] = {}
    for i, own in enumerate(pure):
        for f in own:
            having.setdefault(f, []).append(i)
    left = {f: len(x) for f, x in having.items()}
    chosen, covered = {f for f, n in left.items() if n >= SURE}, [0] * len(pure)
    while left:
        best = max(left, key=lambda f: (left[f], len(f), f))
        if left[best] < LEAST:
            break
        chosen.add(best)
        for i in having[best]:
            covered[i] += 1
            if covered[i] == 2:
                for f in pure[i]:
                    if f in left:
                        left[f] -= 1
        del left[best]
    return chosen


class Chains:
    """Labelled chains, longest first, packed for the likelihood. ``times``: how often each counts."""

    def __init__(self, feats: list, labels: list[np.ndarray], times=None):
        order = np.argsort([-len(y) for y in labels], kind="stable")
        self.times = (np.ones(len(labels)) if times is None else np.asarray(times, float))[order]
        lengths = np.array([len(labels[i]) for i in order])
        self.rows, self.steps = len(labels), int(lengths[0])
        self.live = np.searchsorted(-lengths, -np.arange(self.steps), "left")  # chains that reach each step
        doc = np.repeat(np.arange(self.rows), [len(feats[i][0]) for i in order])
        self.cell = np.concatenate([feats[i][0] for i in order]).astype(np.int64) * self.rows + doc
        self.fid = np.concatenate([feats[i][1] for i in order]).astype(np.int64)
        self.state = np.zeros((self.steps, self.rows))
        for at, i in enumerate(order):
            self.state[: lengths[at], at] = labels[i]
        on = np.arange(1, self.steps)[:, None] < lengths[None, :]
        last, now = self.state[:-1], self.state[1:]
        self.moves = np.array([[(on * self.times * (last == i) * (now == j)).sum() for j in (0, 1)] for i in (0, 1)])


def _likelihood(params: np.ndarray, chains: Chains, index: int) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the chains and its gradient, by scaled forward-backward; params: features, bias, 4 transitions."""
    weight, bias, trans = params[:index], params[index], params[index + 1 :].reshape(2, 2)
    shape = chains.steps, chains.rows
    emit = np.bincount(chains.cell, weight[chains.fid], chains.steps * chains.rows).reshape(shape) + bias
    boost, step = np.exp(np.clip(emit, -50, 50)), np.exp(trans)
    alpha, scale = [], []
    for t, n in enumerate(chains.live.tolist()):
        f = alpha[-1][:n] @ step if t else np.ones((n, 2))
        f[:, 1] *= boost[t, :n]
        scale.append(f.sum(1))
        alpha.append(f / scale[-1][:, None])
    behind = np.ones((chains.rows, 2))
    toxic, moves = np.zeros(shape), np.zeros((2, 2))
    for t in range(chains.steps - 1, -1, -1):
        n = int(chains.live[t])
        toxic[t, :n] = alpha[t][:, 1] * behind[:n, 1]
        if t:
            ahead = behind[:n] / scale[t][:, None]
            ahead[:, 1] *= boost[t, :n]
            moves += step * ((alpha[t - 1][:n] * chains.times[:n, None]).T @ ahead)
            behind[:n] = ahead @ step.T
    total = chains.times.sum()
    log_z = sum(float((chains.times[: len(c)] * np.log(c)).sum()) for c in scale)
    gold = float((chains.times * (emit * chains.state).sum(0)).sum() + (trans * chains.moves).sum())
    off = (toxic - chains.state) * chains.times
    grad = np.concatenate((np.bincount(chains.fid, off.ravel()[chains.cell], index)[:index], [off.sum()], (moves - chains.moves).ravel()))
    return (log_z - gold) / total, grad / total


def descend(chains: Chains, size: int, steps: int = STEPS) -> np.ndarray:
    """Parameters by so many steps of gradient descent with momentum over all chains, at any number of them."""
    params = np.zeros(size + 5)
    params[size] = -4.0
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        _, g = _likelihood(params, chains, size)
        g[:size] += 1e-4 * params[:size]
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        params -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return params


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps of a ridge logistic fit, both kinds weighing the same."""
    w, balance = np.zeros(3), np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (balance * (p - y)) + 1e-4 * w)
    return tuple(w.tolist())


def _mapped(texts: DataFrame, schema: pa.Schema, each, keep: set[int] | None = None, toxic_only: bool = False) -> DataFrame:
    """The tuples that ``each`` (key, toxic, text) yields for the sample's rows ``texts`` (key, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (keep is None or key in keep) and (toxic or not toxic_only):
                    out.extend(each(key, toxic, text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        _buckets.cache_clear()  # workers live on, and would hold it while later stages run

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>", pa.list_(pa.int32()): "array<int>"}
    return texts.select("key", "toxic", "text").mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def fit(texts: DataFrame, cap: int = CAP, steps: int = STEPS, quiet: float = QUIET) -> Model:
    """Train on the rows of ``texts`` (key, toxic 0 or 1, text; a key for each row). Chains are cut into parts of ``cap`` words, so every word is learned from."""
    i64, i32, string = pa.int64(), pa.int32(), pa.string()
    made = _mapped(texts, pa.schema([("key", i64), ("toxic", i32), ("own", pa.list_(i64))]), lambda key, toxic, text: [(key, toxic, sketch(text))])
    rows = sorted((_shuffled(r["key"]), r["key"], r["toxic"], r["own"]) for r in made.toArrow().to_pylist())
    keep = first_of_copies([(key, own) for _, key, _, own in rows])
    toxic = sum(t for _, key, t, _ in rows if key in keep)
    clean = len(keep) - toxic
    if not toxic or not clean:
        return Model()

    def buckets_of(_key, label, text):
        return [(b, label) for b in {b for w in set(words_of(text)) for b in _buckets(w)}]

    counted = _mapped(texts, pa.schema([("bucket", i32), ("toxic", i32)]), buckets_of, keep).groupBy("bucket").agg(F.sum("toxic").alias("n"), F.sum(1 - F.col("toxic")).alias("m"))
    pure = frozenset(r["bucket"] for r in counted.filter((F.col("n") >= LEAST) & (F.col("m") * (toxic / clean) <= IMPURE * F.col("n"))).collect())

    def pure_of(key, _label, text):
        return [(key, sorted({f for w in set(words_of(text)) for f, b in zip(features(w), _buckets(w), strict=True) if b in pure}))]

    found = _mapped(texts, pa.schema([("key", i64), ("own", pa.list_(string))]), pure_of, keep, True)
    place = {key: at for at, (_, key, *_) in enumerate(rows)}
    marks = frozenset(chosen_seeds([r["own"] for r in sorted(found.toArrow().to_pylist(), key=lambda r: place[r["key"]])]))
    if not marks:
        return Model()

    def marked_of(_key, _label, text):
        return Counter(f for w in words_of(text) if not marks.isdisjoint(own := features(w)) for f in own).items()

    pairs = pa.schema([("f", string), ("n", i64)])
    marked = {r["f"]: r["n"] for r in _mapped(texts, pairs, marked_of, keep, True).groupBy("f").agg(F.sum("n").alias("n")).collect()}

    def other_of(_key, _label, text):
        return Counter(f for w in set(words_of(text)) if marks.isdisjoint(own := features(w)) for f in own if f in marked).items()

    other = {r["f"]: r["n"] for r in _mapped(texts, pairs, other_of, keep).groupBy("f").agg(F.sum("n").alias("n")).collect()}
    names = sorted((f for f, n in marked.items() if f in marks or n >= LEAST and n >= other.get(f, 0)), key=lambda f: (-marked[f], f))
    index = {f: i for i, f in enumerate(names)}

    def parts_of(key, label, text):
        words, out, alike = words_of(text), [], Counter()
        for at in range(0, len(words), cap):
            part = words[at : at + cap]
            own = [(i, index[f]) for i, w in enumerate(part) for f in features(w) if f in index]
            if own:
                tags = [i for i, w in enumerate(part) if label and not marks.isdisjoint(features(w))]
                out.append((key, at, len(part), 1, [i for i, _ in own], [f for _, f in own], tags))
            else:
                alike[len(part)] += 1
        return out + [(0, -1, n, times, [], [], []) for n, times in alike.items()]

    schema = pa.schema([("key", i64), ("at", i64), ("size", i32), ("times", i64), ("tok", pa.list_(i32)), ("fid", pa.list_(i32)), ("tags", pa.list_(i32))])
    # Parts without a feature differ in length alone, so each length is one chain that counts as often.
    chains = _mapped(texts, schema, parts_of, keep).groupBy("key", "at", "size", "tok", "fid", "tags").agg(F.sum("times").alias("times")).orderBy("at", "key", "size").toArrow().to_pylist()
    labels = [np.isin(np.arange(r["size"]), r["tags"]).astype(np.int8) for r in chains]
    feats = [(np.array(r["tok"], np.int32), np.array(r["fid"], np.int32)) for r in chains]
    params = descend(Chains(feats, labels, [r["times"] * (1.0 if r["tok"] else quiet) for r in chains]), len(names), steps)
    model = Model(dict(zip(names, params[: len(names)].tolist(), strict=True)), float(params[len(names)]), tuple(params[len(names) + 1 :].tolist()))

    def aggregate_of(key, label, text):
        emit, at, n = model.evidence(text)
        return [(key, label, *model.aggregate(model.marginals(emit, at, n) if at else np.zeros(0)))]

    got = _mapped(texts, pa.schema([("key", i64), ("toxic", i32), ("chance", pa.float64()), ("amount", pa.float64())]), aggregate_of, keep).orderBy("key").toArrow()
    model.calib = calibrated(np.stack([np.ones(got.num_rows), got["chance"].to_numpy(), got["amount"].to_numpy()], 1), got["toxic"].to_numpy().astype(float))
    model.known.clear()
    return model


def _shuffled(key: int) -> int:
    """A place in an order that has nothing to do with the text."""
    return key * 0x9E3779B97F4A7C15 % (1 << 64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on about ``sample`` texts of each label; ``labels`` holds the rows to learn from."""
    own = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    labelled = materialize(rows.select("id", "hash").join(own, "id").distinct(), "toxic-labelled")
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model()
    # A label's texts are cut at sample / n of a uniform hash, so about `sample` of each are drawn: a bounded broadcast.
    rate = F.when(F.col("toxic") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    drawn = labelled.filter(uniform(seed, "id", F.col("hash").cast("string")) < rate)
    found = rows.join(F.broadcast(drawn), ["id", "hash"]).groupBy(F.xxhash64("hash", "toxic").alias("key")).agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    return fit(materialize(found, "toxic-sample"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, toxic words and the character spans for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some thousand features at most, from the bounded sample
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores, spans = [], []
                for t in part.column(1):
                    text = t.as_py()
                    s, places, marginal = own.score(text)
                    scores.append(s)
                    spans.append([{"start": a, "end": b} for a, b in own.spans(text)] if len(places) and (marginal >= 0.5).any() else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(spans, span)], ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def filter_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores under the threshold, with all columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py())[0] < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels with crc32(doc_id) mod 3 other than 1."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(remainder(3) != 1))
    return score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"), "spans")
