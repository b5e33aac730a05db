"""Exact top-k BM25 search with an inverted index and block-max WAND pruning.

Documents are tokenised once into a forward index (term hashes and frequencies) in the shared folder. Global statistics
(documents, mean length, document frequencies) come from pre-aggregated partial counts. Queries are taken in blocks of
bounded text (``QUERY_BYTES``), one after the other: the block's terms with their weights are broadcast, its results are written and the
broadcast is destroyed before the next block is read. Every shard (a slice of about ``SHARD_DOCS`` documents
of a partition, fewer where they hold ``SHARD_POSTINGS``) inverts its documents for those terms and finds its own exact top k. A partition keeps the best k over its shards, whose
last score is the next shard's first threshold; partitions are merged by score. One document in ``FIRST`` (by hash) goes first: the k-th score found
there is the first threshold for all others, in every partition, so each document is searched once and few are scored in full.

In a shard, documents that share their commonest term are neighbours. Terms held by few documents have postings with their
impacts; a common term (one document in ``COMMON`` or more, the commonest where these would make more than ``CELLS`` cells) has a row of impact maxima, quantised upwards, at two widths: blocks of ``BLOCK``
documents and single documents. Block-max WAND's two tests are made for all blocks of a shard at once, and for ``GROUP`` queries that share common terms:

* Queries open the postings of their rare terms, which gives each document a partial score and, where no threshold is known yet, a first one
  (the k-th best of the most promising documents, scored in full).
* A block where the best partial score and the block maxima of all common terms together stay under a query's threshold is skipped for that query.
  The sums for all queries of a group are one matrix product of whole numbers, exact in single precision.
* In the blocks that stay, a document is a pivot if its partial score and its own maxima reach the threshold. Pivots alone are scored in full.
  Documents' maxima are read in spans of ``SPAN`` blocks, from the first to the last that a query of the group keeps.

A query whose term maxima in a shard together stay under its threshold does not look at that shard. All bounds are safe, so the result is that of scoring everything.

Terms are runs of letters or digits in lower case; each distinct term of a query counts once. Results: rows without terms (null, empty) find
nothing and are found by nothing; null ids can be found but do not query; several query rows of one id count as one (the least text
by hash). Ties go to the smaller id, null ids last. Texts are read whole. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

K = 10
K1, B = 1.2, 0.75
BLOCK = 64
COMMON = 32
CELLS = 1 << 24
EXACT = 1 << 24  # whole numbers up to here are exact in single precision
GROUP = 64  # queries, a bit of a word each
SPAN = 8
SHARD_DOCS = 8192
SHARD_POSTINGS = 3_000_000
TASK_DOCS = 1 << 16
QUERY_BYTES = 32 << 20
FIRST = 8
FLUSH_TERMS = 1_000_000
EPS = 1e-6
TINY = 1e-300
TERM = re.compile(r"[^\W_]+")


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All members of the ranges that start at ``first`` and hold ``size`` numbers."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


class Shard:
    """An inverted index over the documents of a shard, for the terms 0 to ``len(idf)`` of a query block."""

    def __init__(self, lengths: np.ndarray, start: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean: float):
        n, v = len(lengths), len(idf)
        self.n, self.idf, self.start, self.term, self.tf = n, idf, start, term, tf
        self.norm = K1 * (1 - B + B * lengths / mean)
        count = np.bincount(term, minlength=v)
        self.at = self._neighbours(lengths)  # the document at each place
        place = np.empty(n, np.int32)
        place[self.at] = np.arange(n, dtype=np.int32)
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
        impact = np.empty(len(term), np.float32)
        for at in range(0, len(term), 1 << 19):
            part = slice(at, at + (1 << 19))
            impact[part] = np.nextafter(self._impact(term[part], tf[part], doc[part]).astype(np.float32), np.float32(np.inf))
        self.top = np.zeros(v, np.float32)
        np.maximum.at(self.top, term, impact)

        blocks = -(-n // BLOCK)
        wide = np.flatnonzero(count > n / COMMON)
        wide = wide[np.argsort(-count[wide], kind="stable")[: CELLS // max(1, blocks * BLOCK)]]
        self.row = np.full(v, -1, np.int32)
        self.row[wide] = np.arange(len(wide))
        # Each row's maxima are whole steps, so few that the sum of all rows is exact.
        steps = min(np.iinfo(np.uint16).max, EXACT // max(1, len(wide)))
        self.step = max(1e-9, float(self.top[wide].max(initial=0.0))) / (steps - 1)
        self.each = np.zeros((len(wide), blocks * BLOCK), np.uint16)
        for at in range(0, len(term), 1 << 19):
            part = slice(at, at + (1 << 19))
            row = self.row[term[part]]
            on = np.flatnonzero(row >= 0)
            self.each[row[on], place[doc[part][on]]] = np.ceil(impact[part][on] / self.step)
        self.most = self.each.reshape(len(wide), blocks, BLOCK).max(2, initial=0)

        rare = np.flatnonzero(self.row[term] < 0)
        rare = np.sort(term[rare].astype(np.int64) << 32 | rare) & 0xFFFFFFFF  # by term, then as they stand
        self.off = np.concatenate(([0], np.cumsum(np.where(self.row < 0, count, 0))))
        self.place, self.impact = place[doc[rare]], impact[rare]
        self.wanted = np.zeros(v, np.uint64)  # a bit for each query of a group
        self.opened = 0  # postings read so far

    def _neighbours(self, lengths: np.ndarray) -> np.ndarray:
        commonest = np.full(self.n, len(self.idf), np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            rank = np.empty(len(self.idf), np.int64)
            rank[np.argsort(self.idf, kind="stable")] = np.arange(len(self.idf))
            commonest[held] = np.minimum.reduceat(rank[self.term], self.start[held])
        return np.lexsort((lengths, commonest))

    def _impact(self, term: np.ndarray, tf: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + self.norm[doc])

    def full(self, docs: np.ndarray, bits: np.ndarray | None = None) -> np.ndarray:
        """The scores of these documents for the terms marked as wanted (by each document's own bit, else the first), from the forward index."""
        out = np.zeros(len(docs))
        bits = np.ones(len(docs), np.uint64) if bits is None else bits
        for lo in range(0, len(docs), 64):
            own = docs[lo : lo + 64]
            size = self.start[own + 1] - self.start[own]
            at = expand(self.start[own], size)
            on = np.flatnonzero(self.wanted[self.term[at]] & np.repeat(bits[lo : lo + 64], size))
            at, whose = at[on], np.searchsorted(np.cumsum(size), on, "right")
            self.opened += len(at)
            out[lo : lo + 64] = np.bincount(whose, self._impact(self.term[at], self.tf[at], own[whose]), len(own))
        return np.round(out, 9)

    def partial(self, terms: np.ndarray, whose: np.ndarray, queries: int) -> np.ndarray:
        """The sums, by query and place, of the impacts of these rare terms; ``whose`` (ascending) is each term's query."""
        width = self.each.shape[1]
        out = np.zeros((queries, width))
        lo, size = self.off[terms], self.off[terms + 1] - self.off[terms]
        for q in range(0, queries, 8):
            part = slice(*np.searchsorted(whose, (q, q + 8)))
            own = min(8, queries - q)
            at = expand(lo[part], size[part])
            if len(at):
                self.opened += len(at)
                where = np.repeat((whose[part] - q) * width, size[part])
                where += self.place[at]
                out[q : q + own] = np.bincount(where, self.impact[at], own * width).reshape(own, width)
        return out

    @staticmethod
    def _best(places: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        return places[np.argpartition(score[places], -k)[-k:]] if len(places) > k else places

    @staticmethod
    def _raised(floor: float, known: np.ndarray, k: int) -> float:
        return max(floor, float(np.partition(known, -k)[-k])) if len(known) >= k else floor

    def search(self, terms: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the best ``k`` and all that tie with the last, of those that reach ``floor``."""
        return self.search_all([terms], k, [floor])[0]

    def search_all(self, queries: list[np.ndarray], k: int, floors: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``search`` for each query; ``GROUP`` neighbours are taken together, so alike queries should be neighbours."""
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        left = []
        for i, terms in enumerate(queries):
            top = self.top[terms]
            if top.any() and top.sum(dtype=np.float64) >= floors[i] - EPS:
                left.append((i, terms[top > 0]))
        for at in range(0, len(left), GROUP):
            some = left[at : at + GROUP]
            found = self._group([terms for _, terms in some], k, np.array([floors[i] for i, _ in some], float))
            for (i, _), own in zip(some, found, strict=True):
                out[i] = own
        return out

    def _group(self, queries: list[np.ndarray], k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        terms, whose = np.concatenate(queries), np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        rows = self.row[terms]
        common = rows >= 0
        done, known = ([np.zeros(0, kind) for _ in queries] for kind in (np.int64, float))
        bit = np.uint64(1) << np.arange(len(queries), dtype=np.uint64)
        for q, own in enumerate(queries):
            self.wanted[own] |= bit[q]

        def read(picked: dict[int, np.ndarray]) -> None:
            """Score these places of these queries in full, which may raise the queries' thresholds."""
            picked = {q: places for q, places in picked.items() if len(places)}
            if not picked:
                return
            size = [len(places) for places in picked.values()]
            scores = self.full(self.at[np.concatenate(list(picked.values()))], np.repeat([bit[q] for q in picked], size))
            for (q, places), own in zip(picked.items(), np.split(scores, np.cumsum(size)[:-1]), strict=True):
                done[q], known[q] = np.concatenate((done[q], places)), np.concatenate((known[q], own))
                floor[q] = self._raised(floor[q], known[q], k)
                score[q, places] = 0.0

        def least() -> np.ndarray:
            return np.maximum(floor * (1 - EPS) - EPS, TINY)

        score = self.partial(terms[~common], whose[~common], len(queries))
        first = {q: self._best(np.flatnonzero(score[q]), score[q], k) for q in np.flatnonzero(floor <= 0).tolist()}
        read(first)
        if common.any():
            used, at = np.unique(rows[common], return_inverse=True)
            asks = np.zeros((len(queries), len(used)), np.float32)
            asks[whose[common], at] = 1
            live = (asks @ self.most[used].astype(np.float32)) * self.step + score.reshape(len(queries), -1, BLOCK).max(2) >= least()[:, None]
            for at in range(0, live.shape[1], SPAN):
                own = live[:, at : at + SPAN]
                here, blocks = np.flatnonzero(own.any(1)), np.flatnonzero(own.any(0))
                if len(here):
                    lo, hi = (at + int(blocks[0])) * BLOCK, (at + int(blocks[-1]) + 1) * BLOCK
                    score[here, lo:hi] += (asks[here] @ self.each[used, lo:hi].astype(np.float32)) * self.step
            score.reshape(len(queries), -1, BLOCK)[~live] = 0.0
            for q, places in enumerate(done):
                score[q, places] = 0.0
        # Pivots: the most promising first, which may raise the threshold for the others.
        whose, near = np.divmod(np.flatnonzero(score >= least()[:, None]), max(1, score.shape[1]))
        near = dict(enumerate(np.split(near, np.searchsorted(whose, np.arange(1, len(queries))))))
        read({q: self._best(places, score[q], k) for q, places in near.items()})
        limit = least()
        read({q: places[score[q, places] >= limit[q]] for q, places in near.items() if len(places) > k})
        self.wanted[terms] = 0

        out = []
        for q in range(len(queries)):
            keep = (known[q] >= floor[q] - EPS) & (known[q] > 0)
            docs, found = self.at[done[q][keep]], known[q][keep]
            if len(docs) > k:
                keep = found >= np.partition(found, -k)[-k]
                docs, found = docs[keep], found[keep]
            out.append((docs, found))
        return out


def alike(query: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """An order of the queries in which those that share common terms are neighbours: by the nearest of a few of them."""
    some = np.argsort(idf, kind="stable")[:256]
    column = np.full(len(idf), -1)
    column[some] = np.arange(len(some))
    whose, at = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), column[query]
    held = np.zeros((len(ends) - 1, len(some)), np.float32)
    held[whose[at >= 0], at[at >= 0]] = 1
    centres = held[np.linspace(0, len(held) - 1, 32).astype(int)] if len(held) else held
    return np.argsort((held @ centres.T - centres.sum(1) / 2).argmax(1), kind="stable") if len(held) else np.zeros(0, np.int64)


def forward(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length, terms, tfs, kind): kind 0 a document, kind 1 partial document frequencies (length: documents, with the sum of lengths as doc_id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("length", pa.int64()), ("terms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("kind", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        held: list[np.ndarray] = []
        count = total = size = 0

        def lists(parts: list[np.ndarray], kind) -> pa.Array:
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))

        def partial():
            term, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([total]), pa.array([count]), lists([term], pa.int64()), lists([n.astype(np.int32)], pa.int32()), pa.array([1], pa.int8())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                length, terms, tfs = [], [], []
                for text in part.column(1):
                    words = Counter(terms_of(text.as_py() or ""))
                    terms.append(np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)).view(np.int64))
                    tfs.append(np.fromiter(words.values(), np.int32, len(words)))
                    length.append(int(tfs[-1].sum()))
                held += terms
                count, total, size = count + len(length), total + sum(length), size + sum(map(len, terms))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int64()), lists(terms, pa.int64()), lists(tfs, pa.int32()), pa.array(np.zeros(len(length), np.int8))], schema=schema)
                if size > FLUSH_TERMS:
                    yield partial()
                    held, count, total, size = [], 0, 0, 0
        yield partial()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, length long, terms array<long>, tfs array<int>, kind byte")


def search(docs: DataFrame, queries: F.Column, k: int = K, query_bytes: int = QUERY_BYTES, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id and score: the best ``k`` of all rows for the rows where ``queries`` (over ``doc_id``) holds."""
    spark = docs.sparkSession
    index = materialize(forward(docs, id_col, text_col), "forward-index", scan=True)
    counts = index.filter("kind = 1")
    n, total = counts.agg(F.sum("length"), F.sum("doc_id")).first()
    freq = counts.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.tfs").alias("df"))
    asked = index.filter("kind = 0 AND doc_id IS NOT NULL").filter(queries).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("terms"), "terms"))["terms"].alias("terms"))
    pairs = asked.select("doc_id", F.explode("terms").alias("term"))
    weighed = materialize(pairs.join(freq, "term").groupBy("doc_id").agg(F.collect_list(F.struct("term", "df")).alias("terms")), "queries")
    size = weighed.agg(F.sum(F.size("terms") * 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // query_bytes))
    n, mean = int(n or 0), max(1.0, (total or 0) / max(1, n or 1))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    # Tasks of many documents, so that a threshold serves several shards, yet short enough to be run again.
    tasks = max(2 * spark.sparkContext.defaultParallelism, n // TASK_DOCS)

    def block(number: int) -> DataFrame:
        rows = weighed.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == number).toArrow()  # about `query_bytes`
        flat = rows["terms"].combine_chunks().flatten()
        term, df = np.asarray(flat.field("term")), np.asarray(flat.field("df"))
        ends = np.concatenate(([0], np.cumsum(np.asarray([len(x) for x in rows["terms"]], np.int64))))
        vocab, at = np.unique(term, return_index=True)
        idf = np.log(1 + (n - df[at] + 0.5) / (df[at] + 0.5))
        query, ids = np.searchsorted(vocab, term).astype(np.int32), np.asarray(rows["doc_id"])
        order = alike(query, ends, idf)
        query, ids, ends = query[expand(ends[order], np.diff(ends)[order])], ids[order], np.concatenate(([0], np.cumsum(np.diff(ends)[order])))
        own = spark.sparkContext.broadcast((vocab, idf, query, ends, ids))
        lot = F.pmod(F.xxhash64("doc_id", "length"), F.lit(FIRST))
        found = materialize(ranked(part(own, lot == 0, None)), "found")
        low = found.filter(F.col("rank") == k).select("query_id", "score").toArrow()
        at = np.argsort(ids, kind="stable")
        floors = np.zeros(len(ids))
        floors[at[np.searchsorted(ids[at], np.asarray(low["query_id"]))]] = np.asarray(low["score"])
        known = spark.sparkContext.broadcast(floors)
        best = materialize(ranked(part(own, lot != 0, known).unionByName(found.drop("rank"))), "found")
        own.destroy()
        known.destroy()
        return best

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def part(own, which: F.Column, low) -> DataFrame:
        """The best of each task over the documents ``which`` holds for, of those that reach the thresholds ``low``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, idf, query, ends, ids = own.value
            floor = np.zeros(len(ids)) if low is None else low.value

            def known(batch: pa.RecordBatch) -> tuple:
                """Of a batch: ids, lengths, and the terms of the query block with their frequencies, counted by document."""
                terms, tfs = batch.column(2), batch.column(3)
                start = np.asarray(terms.offsets, np.int64)
                term, tf = np.asarray(terms.values)[start[0] : start[-1]], np.asarray(tfs.values)[start[0] : start[-1]]
                place = np.minimum(np.searchsorted(vocab, term), max(0, len(vocab) - 1)).astype(np.int32)
                on = vocab[place] == term if len(vocab) else np.zeros(len(term), bool)
                size = np.diff(np.concatenate(([0], np.cumsum(on)))[start - start[0]])
                return batch.column(0), batch.column(1).to_numpy().astype(float), size, place[on], tf[on].astype(np.float32)

            best: dict[int, tuple] = {}  # the best k of each query over the shards of this partition: score, id, no id

            def flush(parts: list[tuple]) -> None:
                named = pa.chunked_array([p[0] for p in parts])
                null, doc = named.is_null().to_numpy(), named.fill_null(0).to_numpy()
                lengths, size, term, tf = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
                parts.clear()
                shard = Shard(lengths, np.concatenate(([0], np.cumsum(size))), term, tf, idf, mean)
                floors = [max(floor[q], best[q][0][k - 1]) if q in best and len(best[q][0]) >= k else floor[q] for q in range(len(ids))]
                for q, (d, s) in enumerate(shard.search_all(np.split(query, ends[1:-1]), k, floors)):
                    have = best.get(q)
                    if len(d):
                        s, i, none = s, doc[d], null[d]
                        if have is not None:
                            s, i, none = np.concatenate((have[0], s)), np.concatenate((have[1], i)), np.concatenate((have[2], none))
                        order = np.lexsort((i, none, -s))[:k]
                        best[q] = s[order], i[order], none[order]

            held, rows, postings = [], 0, 0
            for batch in batches:
                held.append(known(batch))
                rows, postings = rows + batch.num_rows, postings + len(held[-1][3])
                if rows >= shard_docs or postings >= SHARD_POSTINGS:
                    flush(held)
                    rows = postings = 0
            if rows:
                flush(held)
            for at in range(0, len(ids), 10_000):
                some = [(q, best[q]) for q in range(at, min(at + 10_000, len(ids))) if q in best]
                if some:
                    number = np.concatenate([np.full(len(b[0]), ids[q]) for q, b in some])
                    doc = pa.array(np.concatenate([b[1] for _, b in some]), pa.int64(), mask=np.concatenate([b[2] for _, b in some]))
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), doc, pa.array(np.concatenate([b[0] for _, b in some]))], schema=schema)

        rows = index.filter("kind = 0").filter(which).select("doc_id", "length", "terms", "tfs")
        return rows.coalesce(tasks).mapInArrow(run, "query_id long, doc_id long, score double")

    out = block(0)
    for number in range(1, blocks):
        out = out.unionByName(block(number))
    return out


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100."""
    found = search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


SQL = f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT d.doc_id, count(term) AS dl FROM documents d LEFT JOIN w USING (doc_id) GROUP BY 1),
g AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
f AS (SELECT term, ln(1 + ((SELECT n FROM g) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
s AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(idf * t.tf * {K1 + 1} / (t.tf + {K1} * (1 - {B} + {B} * dl / (SELECT mean FROM g)))), 9) AS score
  FROM tf q JOIN tf t USING (term) JOIN f USING (term) JOIN dl ON dl.doc_id = t.doc_id WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {K}"""
