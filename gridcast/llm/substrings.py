"""Substring dedup over words: super-k-mer partitioning by minimisers, exact counting in each bucket.

A window is ``k`` consecutive words of one document. Its minimiser is the smallest hash of the ``m``-word sequences in it, so equal
windows have equal minimisers. Consecutive windows that share one form a piece (a super-k-mer, ``RUN`` windows at most), which is
handled as one packed string: its words, joined by spaces.

Pieces are first listed by minimiser, content hash and place, without their words. Minimisers that occur in one document only are
done with. Of the rest each distinct piece travels once, as a packed string, to the bucket of its minimiser, with the smallest id that
holds it; there the windows of all pieces are ranked by sorting (by words, pairs, fours, eights and so on, so ranks are
equal only for equal words), and a window falls whose smallest id is under the piece's. Places of the same piece under a larger id lose all
its windows. A bucket of over ``HOT`` windows is dealt on by the windows themselves, as 128-bit digests, in grouped minima, so no task holds a
large bucket and nothing is left out. Joins on minimisers and pieces stand between written tables, where adaptive execution can split a hot key.

Results: a null text counts as no words; a null id is neither smaller nor larger than any, so such rows lose nothing and take nothing from others.
Rows that agree in id are one document: none removes words of another. Empty texts and texts under ``k`` words stay.
Texts of any length are read whole. An empty table gives an empty result. Other columns are carried, whatever their names; only
``n_words``, ``removed_words`` and ``kept_text`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, private, table

WINDOW = 13
MINIMISER = 4
RUN = 256
HOT = 1 << 18
SLICE = 1 << 24

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and the offsets of each text's words. A null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, cuts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return flat, cuts.astype(np.int64)
    return flat.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[cuts]


def sliced(batch: pa.RecordBatch, at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in the column ``at``; one long text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    coded = words.dictionary_encode()
    own = np.fromiter((xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)


def super_kmers(hashes: np.ndarray, cuts: np.ndarray, k: int = WINDOW, m: int = MINIMISER, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser, content hash) of each piece of the texts with these word hashes."""
    none = np.zeros(0, np.int64)
    if len(hashes) < k:
        return none, none, none, none
    with np.errstate(over="ignore"):
        gram = np.zeros(len(hashes) - m + 1, np.uint64)
        for i in range(m):
            gram = gram * _STEP + hashes[i : i + len(gram)]
        gram = (gram ^ gram >> np.uint64(31)) * np.uint64(_BASE)
        gram ^= gram >> np.uint64(29)
        n = len(hashes) - k + 1
        least = gram[:n].copy()
        for i in range(1, k - m + 1):
            np.minimum(least, gram[i : i + n], out=least)
        text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        whole = text[:n] == text[k - 1 :]
        fresh = whole.copy()
        fresh[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1])
        first = np.flatnonzero(fresh)
        # A run ends where the next begins or where windows end; long ones are cut, so that no piece is longer than ``run`` windows.
        stop = np.flatnonzero(whole & np.concatenate((~whole[1:] | fresh[1:], [True]))) + 1
        parts = -(-(stop - first) // run)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(first, parts) + nth * run
        size = np.minimum(np.repeat(stop, parts) - start, run)
        power = np.full(len(hashes) + 1, np.uint64(_BASE))
        power[0] = 1
        back = np.full(len(hashes) + 1, np.uint64(_BACK))
        back[0] = 1
        power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)))
        content = (total[start + size + k - 1] - total[start]) * back[start] + size.astype(np.uint64)
        content = (content ^ content >> np.uint64(33)) * _STEP
        content ^= content >> np.uint64(32)
    return start, size, least[start].view(np.int64), content.view(np.int64)


def pieces(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, run: int = RUN) -> DataFrame:
    """(id, t, at, n, h, c): place, windows, minimiser and content hash of every piece. ``docs``: id, t, text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 2):
                words, cuts = words_of(part.column(2))
                start, size, h, c = super_kmers(word_hashes(words), cuts, k, m, run)
                row = np.searchsorted(cuts, start, side="right") - 1
                at = pa.array((start - cuts[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), at, pa.array(size.astype(np.int32)), pa.array(h), pa.array(c)], ["id", "t", "at", "n", "h", "c"])

    return docs.select("id", "t", "text").mapInArrow(split, "id long, t long, at int, n int, h long, c long")


def packed(rows: DataFrame, k: int = WINDOW) -> DataFrame:
    """(h, c, first, s): the packed strings of the wanted pieces. ``rows``: text, want (array of h, c, first, at, n)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 0):
                words, cuts = words_of(part.column(0))
                want = part.column(1)
                own = want.flatten()
                base = np.repeat(cuts[:-1], pc.list_value_length(want).to_numpy())
                size = own.field("n").to_numpy().astype(np.int64) + k - 1
                ends = np.concatenate(([0], np.cumsum(size)))
                index = np.arange(ends[-1]) + np.repeat(base + own.field("at").to_numpy() - ends[:-1], size)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.take(pa.array(index)))
                yield pa.RecordBatch.from_arrays([own.field("h"), own.field("c"), own.field("first"), pc.binary_join(lists, " ")], ["h", "c", "first", "s"])

    return rows.select("text", "want").mapInArrow(cut, "h long, c long, first long, s string")


def ranked(ids: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """A number for the ``k`` words at each place (but the last ``k`` - 1): equal if and only if the words are."""

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    have, length, power, size = None, 0, ids, 1
    while True:
        if k & size:
            have, length = (power, size) if have is None else (both(have[: len(ids) - length - size + 1], power[length : len(ids) - size + 1]), length + size)
        if size * 2 > k:
            return have
        power, size = both(power[: len(power) - size], power[size:]), size * 2


def lower(pieces_: pa.Array, first: np.ndarray, k: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each packed string the runs (first, last) of its windows that also occur in one with a smaller ``first``."""
    lists = pc.split_pattern(pieces_, " ")
    cuts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    rank = ranked(coded.indices.to_numpy().astype(np.int64), k)
    piece = np.repeat(np.arange(len(pieces_)), np.diff(cuts))
    at = np.flatnonzero(piece[: len(rank)] == piece[k - 1 :])
    rank, own = rank[at], piece[at]
    order = np.argsort(rank, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(rank[order]) != 0)))
    least = np.empty(len(rank), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(first[own][order], heads), np.diff(np.concatenate((heads, [len(rank)]))))
    gone = np.flatnonzero(least < first[own])
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(pieces_))]
    if len(gone):
        head = np.concatenate(([True], (np.diff(at[gone]) != 1) | (np.diff(own[gone]) != 0)))
        tail = np.concatenate((head[1:], [True]))
        for p, f, l in zip(own[gone][head].tolist(), at[gone][head].tolist(), at[gone][tail].tolist(), strict=True):
            found[p].append((f - int(cuts[p]), l - int(cuts[p])))
    return found


RUNS = "array<struct<f:int,l:int>>"


def count_buckets(strings: DataFrame, k: int = WINDOW, held: int = HOT) -> DataFrame:
    """(h, c, runs) of the pieces in which windows fall, each bucket counted in one task. ``strings``: h, c, first, s."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("runs", pa.list_(pa.struct([("f", pa.int32()), ("l", pa.int32())])))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(tab: pa.Table) -> pa.RecordBatch:
            h, c = tab["h"].to_numpy(), tab["c"].to_numpy()
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))  # repeated rows bring a piece again
            tab = tab.filter(pa.array(fresh))
            runs = lower(tab["s"].combine_chunks(), tab["first"].to_numpy(), k)
            some = np.array([i for i, r in enumerate(runs) if r], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[fresh][some]), pa.array(c[fresh][some]), pa.array([[{"f": f, "l": l} for f, l in runs[i]] for i in some], schema.field(2).type)], schema=schema)

        parts: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            parts.append(batch)
            size += batch.nbytes
            if size > held * 8:
                tab = pa.Table.from_batches(parts)
                h = tab["h"].to_numpy()
                if end := int(np.searchsorted(h, h[-1])):
                    yield flush(tab.slice(0, end))
                    # Copied, as a slice would keep (and count) all that it is cut from.
                    parts = tab.slice(end).take(np.arange(len(tab) - end)).to_batches()
                    size = sum(p.nbytes for p in parts)
        if parts:
            yield flush(pa.Table.from_batches(parts))

    return strings.repartition("h").sortWithinPartitions("h", "c").mapInArrow(count, f"h long, c long, runs {RUNS}")


def count_windows(strings: DataFrame, k: int = WINDOW) -> DataFrame:
    """As ``count_buckets`` for buckets of any size: each window goes its own way, as a 128-bit digest."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in sliced(batch, 3, SLICE >> 4):
                row, at, w = [], [], []
                for i, s in enumerate(part.column(3).cast(pa.binary()).to_pylist()):
                    own = s.split(b" ")
                    for j in range(len(own) - k + 1):
                        row.append(i)
                        at.append(j)
                        w.append(xxh3_128_digest(b" ".join(own[j : j + k])))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(row, pa.int32())) for i in range(3)], pa.array(at, pa.int32()), pa.array(w, pa.binary())], ["h", "c", "first", "at", "w"])

    every = materialize(strings.mapInArrow(windows, "h long, c long, first long, at int, w binary"), "hot-windows", scan=True)
    least = materialize(every.groupBy("w").agg(F.min("first").alias("least")), "hot-least")
    gone = every.join(least, "w").filter("least < first")
    return gone.groupBy("h", "c").agg(F.collect_set("at").alias("_at")).select("h", "c", F.transform("_at", lambda x: F.struct(x.alias("f"), x.alias("l"))).cast(RUNS).alias("runs"))


def spans(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, run: int = RUN, hot: int = HOT) -> DataFrame:
    """(id, t, spans): ranges of words that fall, not yet merged, for each document that has any. ``docs``: id, t, text."""
    listed = materialize(pieces(docs.filter("id IS NOT NULL"), k, m, run), "pieces", scan=True)
    shared = materialize(listed.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h"), "shared-minimisers")
    again = materialize(listed.join(shared, "h"), "shared-pieces")
    one = F.min(F.struct("id", "t", "at", "n")).alias("one")
    kinds = materialize(again.groupBy("h", "c").agg(one, F.max("id").alias("last")).withColumn("first", F.col("one.id")), "piece-kinds")
    sizes = materialize(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("one.n").alias("windows")).filter("kinds > 1"), "bucket-sizes")
    compare = kinds.join(sizes, "h").select("h", "c", "first", "one", (F.col("windows") > hot).alias("hot"))
    wanted = F.struct("h", "c", "first", F.col("one.at").alias("at"), F.col("one.n").alias("n"))

    def strings(which: DataFrame) -> DataFrame:
        own = which.groupBy(F.col("one.id").alias("_id"), F.col("one.t").alias("_t")).agg(F.collect_list(wanted).alias("want"))
        return packed(docs.join(own, (F.col("id") == F.col("_id")) & (F.col("t") == F.col("_t"))), k)

    runs = count_buckets(strings(compare.filter(~F.col("hot"))), k, hot)
    if not sizes.filter(F.col("windows") > hot).isEmpty():
        runs = runs.unionByName(count_windows(strings(compare.filter("hot")).dropDuplicates(["h", "c"]), k))
    runs = materialize(runs, "falling-windows")
    marks = materialize(kinds.join(runs, ["h", "c"], "left").filter("last > first OR runs IS NOT NULL").select("h", "c", "first", "runs"), "piece-marks")
    all_of_it = F.array(F.struct(F.lit(0).alias("f"), (F.col("n") - 1).alias("l"))).cast(RUNS)
    hits = again.join(marks, ["h", "c"]).select("id", "t", "at", F.explode(F.when(F.col("id") > F.col("first"), all_of_it).otherwise(F.col("runs"))).alias("run"))
    ranges = hits.select("id", "t", (F.col("at") + F.col("run.f")).alias("s"), (F.col("at") + F.col("run.l") + k).alias("e")).distinct()
    return ranges.groupBy("id", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", m: int = MINIMISER, run: int = RUN, hot: int = HOT) -> DataFrame:
    """``docs`` with ``n_words``, ``removed_words`` (maximal ranges of word numbers) and ``kept_text`` (the rest, joined by spaces)."""
    docs = docs.drop("n_words", "removed_words", "kept_text")
    p = private(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({f"{p}text": text, f"{p}id": F.col(id_col).cast("long"), f"{p}t": F.xxhash64(text)})
    found = materialize(spans(keyed.select(F.col(f"{p}id").alias("id"), F.col(f"{p}t").alias("t"), F.col(f"{p}text").alias("text")), k, m, run, hot), "word-spans")
    found = found.withColumnsRenamed({"id": f"{p}sid", "t": f"{p}st", "spans": f"{p}spans"})
    both = keyed.join(found, (F.col(f"{p}id") == F.col(f"{p}sid")) & (F.col(f"{p}t") == F.col(f"{p}st")), "left").select(*docs.columns, f"{p}text", f"{p}spans")
    names, width = [*docs.columns, "n_words", "removed_words", "kept_text"], len(docs.columns)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    schema = T.StructType(list(docs.schema.fields)).add("n_words", "long").add("removed_words", T.ArrayType(T.StructType().add("s", "integer").add("e", "integer"))).add("kept_text", "string")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, width):
                words, cuts = words_of(part.column(width))
                own = part.column(width + 1)
                count = pc.fill_null(pc.list_value_length(own), 0).to_numpy()
                flat = own.flatten()
                base = np.repeat(cuts[:-1], count)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, base + flat.field("s").to_numpy(), 1)
                np.add.at(step, base + flat.field("e").to_numpy(), -1)
                gone = np.cumsum(step)[: len(words)] > 0
                row = np.repeat(np.arange(part.num_rows), np.diff(cuts))
                edge = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
                head = np.flatnonzero(gone & (edge | ~np.concatenate(([False], gone[:-1]))))
                tail = np.flatnonzero(gone & np.concatenate((edge[1:] | ~gone[1:], [True])))
                at = row[head]
                ranges = pa.StructArray.from_arrays([pa.array((head - cuts[at]).astype(np.int32)), pa.array((tail + 1 - cuts[at]).astype(np.int32))], ["s", "e"])
                removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(part.num_rows + 1)).astype(np.int32)), ranges)
                left = np.concatenate(([0], np.cumsum(~gone)))[cuts]
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(~gone))), " ")
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(width)], pa.array(np.diff(cuts)), removed.cast(kind), kept], names)

    return both.mapInArrow(remove, schema)


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and the hash of the rest."""
    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed_words", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"])
    return rows.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
lists AS (SELECT doc_id, range(1, len(ws) - 11) AS place, list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')) AS w FROM split WHERE len(ws) >= 13),
named AS (SELECT doc_id, unnest(place) AS i, unnest(w) AS w FROM lists),
firsts AS (SELECT w, min(doc_id) AS first FROM named GROUP BY w),
gone AS (SELECT DISTINCT n.doc_id, unnest(range(n.i, n.i + 13)) AS i FROM named n JOIN firsts f ON n.w = f.w WHERE f.first < n.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text, count(*) AS n FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(len(s.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
