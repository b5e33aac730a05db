"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius.

Fingerprints are made in Arrow batches next to the scan. Equal fingerprints are collapsed first, so a group of copies costs one
row. Candidates come from the pigeonhole rule: with ``b`` blocks of bits, two fingerprints within
``radius`` bits agree on at least ``b - radius`` whole blocks, so a table for each choice of that many blocks finds every
link. More distinct fingerprints take more blocks, which keeps buckets small. A bucket over
``BUCKET`` rows is dealt once more by ``radius + 1`` interleaved bit classes, of which a link leaves one unchanged, and what is still
over it as pairs of blocks of half that size, so that every two of its rows meet and no task holds more than ``BUCKET`` of them.

Inside a bucket the comparison is bit-sliced: bit planes are stored vertically (word ``w`` of plane ``p`` holds bit ``p`` of 64
fingerprints), the XOR planes of one query are added into carry-save counters of a few bitwise operations for 64
distances at a time, and words are dropped once all their distances exceed the radius. A bucket's links are reduced to
a spanning forest in place, so a dense group emits as many edges as it has members, and no link between
different fingerprints is lost for the components.

``dedup`` takes its candidates from long fingerprints that share a block of bits and are within a radius, and from an exact way beside them for the pairs
that these miss; links are the candidates whose Jaccard similarity, computed from the sets of shingle hashes, is reached, so that no pair of the similarity is lost.

Results: a fingerprint's component is the smallest id reachable over links. Null text counts as no words
(fingerprint zero, linked like any other); null ids get the component of their fingerprint and never
name one. Ties and repeated rows share a fingerprint and thus a component. Empty tables give empty results; very long texts are read whole; other
columns are not read, and ``dedup`` carries them along whatever their names. Sets of shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mark_seen, materialize, private, seen_bitmap, table
from .components import components

WORDS = 3
RADIUS = 3
SEED = 42
BUCKET = 20_000
SMALL = 12
BLOCK_BITS = 16
NEAR = 7 / 32
FAR = 5 / 16
SAMPLE = 3000
OFTEN = 3
LISTED = 100_000
SHINGLES = 1 << 20


def hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of one UTF-8 text, in order; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: A-Z, and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist() if len(found) > words else [0]
    ends = ends[words - 1 :].tolist() if len(found) > words else [len(joined)]
    return np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), "<u8", len(starts))


def majority(found: np.ndarray, prints: int = 1) -> np.ndarray:
    """The SimHash of shingle hashes: ``prints`` words of 64 bits, the first of them over XXH64, the others over mixes of it."""
    total = np.zeros(64 * prints, np.int64)
    for at in range(0, len(found), 16_384):
        part = found[at : at + 16_384]
        for k in range(prints):
            bits = np.unpackbits((part if k == 0 else _mix(part, k)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[64 * k : 64 * k + 64] += bits.sum(0, dtype=np.int64) if len(bits) > 255 else bits.sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(found), bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED, prints: int = 1) -> np.ndarray:
    """The SimHash of one UTF-8 text over all its shingles."""
    return majority(hashes(text, words, seed), prints)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, prints: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long where it has one word, else as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py() or b"", words, seed, prints) for t in batch.column(1)]
            fp = pa.array(np.array(made, np.uint64).reshape(-1).view(np.int64), pa.int64()) if prints == 1 else pa.array([m.tobytes() for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, fp {'long' if prints == 1 else 'binary'}")


class Counter:
    """Carry-save counters of 64 distances a word: ``bits`` holds the counts' binary digits, ``over`` what exceeds the radius."""

    def __init__(self, radius: int, words: int):
        self.radius = radius
        self.bits = np.zeros(((radius + 1).bit_length(), words), np.uint64)
        self.over = np.zeros(words, np.uint64)

    def add(self, plane: np.ndarray) -> None:
        carry = plane & ~self.over
        for digit in self.bits:
            digit ^= carry
            carry &= ~digit
        self.over |= carry
        full = ~self.over
        for k, digit in enumerate(self.bits):
            full &= digit if (self.radius + 1) >> k & 1 else ~digit
        self.over |= full

    def keep(self, which: np.ndarray) -> None:
        self.bits, self.over = self.bits[:, which], self.over[which]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, or n x words): a row for each bit, 64 fingerprints a word; lanes past the end hold zeros."""
    fps = fps.reshape(len(fps), -1)
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, query: np.ndarray, wanted: np.ndarray, radius: int) -> np.ndarray:
    """The indexes among ``wanted`` lanes (a bit mask) within the radius of ``query`` (its words)."""
    words = np.flatnonzero(wanted)
    count = Counter(radius, len(words))
    bits = np.unpackbits(np.atleast_1d(query).view(np.uint8), bitorder="little").tolist()
    for p, bit in enumerate(bits):
        row = planes[p, words]
        count.add(~row if bit else row)
        if p % 8 == 7:
            alive = np.flatnonzero(~count.over & wanted[words])
            if not len(alive):
                return alive
            if len(alive) < len(words):
                words = words[alive]
                count.keep(alive)
    mask = ~count.over & wanted[words]
    lanes = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))
    return words[lanes // 64] * 64 + lanes % 64


def close(fps: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Which long fingerprints (n x words) are within the radius; wide radii stop bit planes too late to be worth them."""
    return np.bitwise_count(fps ^ query).sum(1, dtype=np.int64) <= radius


def bucket_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the distinct fingerprints of one bucket, as index pairs."""
    if fps.ndim > 1 and fps.shape[1] > 1:
        return long_forest(fps, radius)
    planes, n = planes_of(fps), len(fps)
    left = np.zeros(planes.shape[1] * 64, np.uint8)
    left[:n] = 1
    left = np.packbits(left, bitorder="little").view(np.uint64)
    a, b = [], []
    for seed in range(n):
        word, lane = seed >> 6, np.uint64(1 << (seed & 63))
        if not left[word] & lane:
            continue
        left[word] &= ~lane
        stack = [seed]
        while stack:
            at = stack.pop()
            near = within(planes, fps[at], left, radius)
            if len(near):
                np.bitwise_and.at(left, near >> 6, ~(np.uint64(1) << (near & 63).astype(np.uint64)))
                a.append(np.full(len(near), at))
                b.append(near)
                stack += near.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def long_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for fingerprints of several words, by their distances."""
    left = np.arange(len(fps))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            hit = close(fps[left], fps[at], radius)
            near, left = left[hit], left[~hit]
            a.append(np.full(len(near), at))
            b.append(near)
            stack += near.tolist()
    return np.concatenate(a), np.concatenate(b)


def pairs_within(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of fingerprints are within the radius, 64 pairs a word."""
    out = []
    size = (1 << 16) // (x.size // max(1, len(x)) or 1)
    for at in range(0, len(x), size):
        if x.ndim > 1 and x.shape[1] > 1:
            out.append(close(x[at : at + size], y[at : at + size], radius))
            continue
        planes = planes_of(x[at : at + size] ^ y[at : at + size])
        count, n = Counter(radius, planes.shape[1]), len(x[at : at + size])
        for p in range(len(planes)):
            count.add(planes[p])
            if p % 16 == 15 and not (~count.over).any():
                break
        out.append(np.unpackbits((~count.over).view(np.uint8), bitorder="little")[:n].astype(bool))
    return np.concatenate(out) if out else np.zeros(0, bool)


def linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as index pairs, among fingerprints that share a key; rows are sorted by key.

    All links of buckets up to ``SMALL`` rows, a forest of larger ones.
    """
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((cuts, [len(keys)])))
    size_of = np.repeat(sizes, sizes)
    none = np.zeros(0, np.int64)
    u, v = [none], [none]
    for shift in range(1, min(SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero((keys[shift:] == keys[:-shift]) & (size_of[shift:] <= SMALL))
        i = i[pairs_within(fps[i], fps[i + shift], radius)]
        u.append(i)
        v.append(i + shift)
    for at, n in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        a, b = bucket_forest(fps[at : at + n], radius)
        u.append(at + a)
        v.append(at + b)
    return np.concatenate(u), np.concatenate(v)


def _joined(dealt: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of the buckets of ``dealt`` (id, key, fp binary), as ``linked`` finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(tab: pa.Table):
            fps = np.frombuffer(b"".join(tab["fp"].to_pylist()), np.uint64).reshape(tab.num_rows, -1)
            u, v = linked(tab["key"].to_numpy(), fps, radius)
            ids = tab["id"].to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["u", "v"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 200_000:  # whole keys only; the last one waits for its rest
                tab = pa.Table.from_batches(held)
                keys = tab["key"].to_numpy()
                end = int(np.searchsorted(keys, keys[-1]))
                if end:
                    yield flush(tab.slice(0, end))
                held, rows = tab.slice(end).to_batches(), 0
        if rows or held:
            yield flush(pa.Table.from_batches(held))

    return dealt.select("id", "key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def similar_links(fps: DataFrame, radius: int, prints: int, bits: int = BLOCK_BITS, bucket: int = BUCKET) -> DataFrame:
    """Forest edges (u, v) over long fingerprints ``fps`` (id, fp binary) that share a block of ``bits`` bits and are within the radius.

    Buckets over ``bucket`` rows are dealt as pairs of blocks of half that size, so every two rows of a bucket still meet.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"<u{bits // 8}").reshape(batch.num_rows, -1)
            for t in range(fp.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp[:, t].astype(np.int64) << 16 | t)], ["id", "key"])

    # Fingerprints are brought to the rows that meet others: they are most of a row.
    keyed = fps.select("id", "fp").mapInArrow(key, "id long, key long")
    return _joined(_dealt(keyed, 1, bucket).join(fps.select("id", "fp"), "id"), radius)


def _dealt(keyed: DataFrame, least: int, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``keyed`` whose key has more than ``least``, those of keys over ``bucket`` as pairs of blocks of half that size."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    blocks = F.when(F.col("n") > bucket, F.ceil(F.col("n") * 2 / bucket)).otherwise(1).cast("int")
    dealt = keyed.join(sizes, "key").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).drop("n", "blocks", "mine", "other")


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _signed(mask: int) -> F.Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def links(fps: DataFrame, count: int, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Forest edges (u, v) that connect the distinct fingerprints ``fps`` (fp) as their links do; ``count`` is their number."""
    blocks = radius + (1 if count < 1 << 22 else 2 if count < 1 << 30 else 3)

    def key(fp, mask: int, tag: int):
        return F.xxhash64(F.lit(tag), fp.bitwiseAND(_signed(mask)))

    fp = F.col("fp")
    keyed = fps.select("fp", F.explode(F.array(*[key(fp, m, t) for t, m in enumerate(_masks(blocks, radius))])).alias("key"))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("key", F.lit(True).alias("_large"))
    classes = [sum(1 << i for i in range(c, 64, radius + 1)) for c in range(radius + 1)]
    again = F.array(*[F.xxhash64("key", F.lit(c), fp.bitwiseAND(_signed(m))) for c, m in enumerate(classes)])
    dealt = keyed.join(large, "key", "left").select(fp.alias("id"), F.explode(F.when(F.col("_large"), again).otherwise(F.array("key"))).alias("key"))

    # Java writes the high byte first; the planes do not mind the order of bytes.
    return _joined(_dealt(dealt, 1, bucket).withColumn("fp", F.unhex(F.lpad(F.hex("id"), 16, "0"))), radius)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest id reachable over links within ``radius`` bits) of every row."""
    prints_of = materialize(fingerprints(docs, words, seed, 1, id_col, text_col).withColumn("id", F.col("fp")), "simhash", scan=True)
    distinct = prints_of.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("first"))
    named = components(links(distinct.select("fp"), distinct.count(), radius)).select(F.col("node").alias("id"), F.col("component").alias("root"))
    rooted = distinct.select("id", "first").join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints_of.join(rooted.join(lowest, "root").select("id", "component_id"), "id").select("doc_id", "fp", "component_id")


def least_shared(n: int, similarity: float) -> int:
    """The shingles that a set of ``n`` shares at least with any set of this Jaccard similarity."""
    return math.ceil(similarity * n - 1e-9)


def set_id(found: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set of shingle hashes."""
    from xxhash import xxh64_intdigest

    name = xxh64_intdigest(found.tobytes())
    return name - (1 << 64) if name >> 63 else name


def common_shingles(docs: DataFrame, words: int, seed: int, text_col: str) -> np.ndarray:
    """Hashes in ``OFTEN`` or more of about ``SAMPLE`` texts, the rarest first. They come last among the keys, which any order may; this one keeps buckets small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = np.unique(hashes(text.as_py() or b"", words, seed))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64), pa.int64())], ["key"])

    text = F.col(text_col).cast("string")
    share = SAMPLE / max(SAMPLE, docs.count())
    drawn = docs.select(text.alias("text")).filter((F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))).distinct()
    often = drawn.select(F.col("text").cast("binary")).mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    return np.array([r["key"] for r in often.orderBy(F.desc("n"), "key").limit(LISTED).collect()][::-1], np.int64).view(np.uint64)


def sketches(docs: DataFrame, words: int, similarity: float, prints: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, hash of the text, and of its set of shingles the id, the fingerprint and the keys: the first in one order of all hashes, so many that sets of the similarity share one."""
    common = common_shingles(docs, words, seed, text_col)
    by_hash = np.argsort(common)
    held = common[by_hash]

    def first(found: np.ndarray) -> np.ndarray:
        n = len(found) - least_shared(len(found), similarity) + 1
        at = np.searchsorted(held, found)
        hit = held[np.minimum(at, len(held) - 1)] == found if len(held) else np.zeros(len(found), bool)
        return np.concatenate([found[~hit], common[np.sort(by_hash[at[hit]])]])[:n] if len(found) else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, keys = [], [], []
            for text in batch.column(2):
                found = np.unique(hashes(text.as_py() or b"", words, seed))
                ids.append(set_id(found))
                fps.append(majority(found, prints).tobytes())
                keys.append(first(found).view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            made = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *keys]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), made], ["doc_id", "text_hash", "id", "fp", "keys"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(run, "doc_id long, text_hash long, id long, fp binary, keys array<long>")


def sets_of(wanted: DataFrame, docs: DataFrame, first: DataFrame, words: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, held): the sorted shingle hashes of the sets ``wanted`` (id); ``first`` (id, first) names a document of each set.

    Texts are read again where a bitmap may hold their id; only wanted sets move.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(t.as_py() or b"", words, seed)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "held"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    # A set without any id is that of rows with null ids, which are read again as well.
    seen = mark_seen(rows, seen_bitmap(first.join(wanted, "id"), "first"), F.col("_id")).filter(F.col("_seen") | F.col("_id").isNull()).select("_text")
    return materialize(seen.mapInArrow(shingled, "id long, held binary").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "simhash-sets")


def verified(pairs: DataFrame, similarity: float, sets) -> DataFrame:
    """The ``pairs`` (u, v) of set ids whose sets have the Jaccard similarity; ``sets`` (wanted) reads them."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["u", "v"])

    held = sets(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    left = pairs.join(held.select(F.col("id").alias("u"), F.col("held").alias("_x")), "u")
    both = left.join(held.select(F.col("id").alias("v"), F.col("held").alias("_y")), "v").select("u", "v", "_x", "_y")
    return materialize(both.mapInArrow(similar, "u long, v long"), "simhash-links")


def exact_forest(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Index pairs of sets at the Jaccard similarity that join different labels, no more than join them: each set meets all others by its shingles."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    holders, edge = owner[order], np.concatenate(([0], np.cumsum(np.bincount(at))))
    start = np.concatenate(([0], np.cumsum(size)))
    _, group = np.unique(labels, return_inverse=True)
    a, b = [], []
    for i in range(len(sets)):
        own = at[start[i] : start[i + 1]]
        if not len(own):
            continue
        both = np.bincount(np.concatenate([holders[edge[k] : edge[k + 1]] for k in own.tolist()]), minlength=len(sets))
        near = np.flatnonzero((both >= similarity * (size + size[i] - both) - 1e-9) & (group != group[i]))
        for j in near.tolist():
            if group[j] != group[i]:
                a.append(i)
                b.append(j)
                group[group == group[j]] = group[i]
    return a, b


def decided(rows: DataFrame, similarity: float, limit: int = SHINGLES) -> DataFrame:
    """Links (u, v) that join the labels of each component of candidates as all its sets of the similarity do. ``rows``: id, label, comp, held.

    A component is dealt as pairs of blocks of about ``limit`` shingles, so any two of its sets meet in one task; a task
    emits no more links than it has sets.
    """
    total = rows.groupBy("comp").agg(F.sum(F.octet_length("held") / 8).alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("int")
    dealt = rows.join(total, "comp").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select("id", "label", "held", F.xxhash64("comp", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(own: list[tuple]) -> pa.RecordBatch:
            a, b = exact_forest([np.frombuffer(r[2], np.uint64) for r in own], np.array([r[1] for r in own]), similarity)
            return pa.RecordBatch.from_arrays([pa.array([own[i][0] for i in a], pa.int64()), pa.array([own[j][0] for j in b], pa.int64())], ["u", "v"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][3] != row[3]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, prints: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, root (of the component) and id (of the set of shingles) of every row; links are all pairs of sets at the Jaccard similarity.

    SimHash comes first: fingerprints that share a block of bits and are within ``NEAR`` of all their bits are candidates. An exact way finds the rest, which share no block or
    are farther apart: sets of the similarity share one of their smallest hashes (the first in one order, common ones last), so they meet in a bucket of that key, where
    the fingerprints set aside what is farther than ``FAR`` of the bits. What is left of both is decided by the sets. Buckets over ``SMALL`` give a forest of candidates first; where
    one of these fails, the sets of its whole component of candidates meet in blocks and are decided there, without a row for each pair.
    """
    rows = materialize(sketches(docs, words, similarity, prints, seed, id_col, text_col), "simhash", scan=True)
    distinct = materialize(rows.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("first"), F.first("keys").alias("keys")), "simhash-sets")
    keyed = distinct.select("id", F.explode("keys").alias("key"))
    fps, first, radius = distinct.select("id", "fp"), distinct.select("id", "first"), int(FAR * 64 * prints)

    def sets(wanted: DataFrame) -> DataFrame:
        return sets_of(wanted, docs, first, words, seed, id_col, text_col)

    ordered = lambda found: found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    near = materialize(ordered(similar_links(fps, int(NEAR * 64 * prints), prints)), "simhash-near")
    rest = ordered(_joined(_dealt(keyed, 1).join(fps, "id"), radius))
    pairs = materialize(near.union(rest).distinct(), "simhash-pairs")
    good = verified(pairs, similarity, sets)
    named = components(good).select(F.col("node").alias("id"), F.col("component").alias("root"))
    failed = materialize(pairs.join(good, ["u", "v"], "left_anti"), "simhash-failed")
    if not failed.isEmpty():
        tops = components(pairs).select(F.col("node").alias("id"), F.col("component").alias("comp"))
        member = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct().join(tops, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        labelled = materialize(member.join(named, "id", "left").select("id", "comp", F.coalesce("root", "id").alias("label")), "simhash-members")
        open_ = failed.join(labelled.select(F.col("id").alias("u"), "comp", F.col("label").alias("x")), "u").join(labelled.select(F.col("id").alias("v"), F.col("label").alias("y")), "v")
        open_ = open_.filter("x <> y").select("comp").distinct()
        left = materialize(labelled.join(open_, "comp"), "simhash-open")
        if not left.isEmpty():
            more = materialize(decided(left.join(sets(left.select("id")), "id"), similarity), "simhash-more")
            named = components(good.union(more)).select(F.col("node").alias("id"), F.col("component").alias("root"))
    return rows.select("doc_id", "text_hash", "id").join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))


def dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, prints: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component: the smallest id, with the smaller hash of the text where an id has several; null ids come last.

    Rows are told apart by id and text, so another text under a repeated id has its own fate. Of rows that agree in both one stays, whichever.
    All columns are kept, whatever their names.
    """
    found = near_copies(docs, words, similarity, prints, seed, id_col, text_col).withColumn("row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    found = materialize(found.groupBy("root", "row").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    lowest = found.groupBy("root").agg(F.min("row").alias("lowest"))
    gone = found.join(lowest, "root").filter(~F.col("row").eqNullSafe(F.col("lowest"))).select("row")
    twins = found.join(lowest, "root").filter(F.col("row").eqNullSafe(F.col("lowest")) & (F.col("n") > 1)).select("row")
    p = private(docs)
    own = lambda rows: rows.select(F.col("row.doc_id").alias(f"{p}id"), F.col("row.text_hash").alias(f"{p}hash"))
    match = F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(f"{p}hash"))
    kept = docs.join(own(gone), match, "left_anti")
    if twins.isEmpty():
        return kept
    once = kept.join(own(twins), match, "left_semi").withColumn(f"{p}text", F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, f"{p}text"]).drop(f"{p}text")
    return kept.join(own(twins), match, "left_anti").unionByName(once)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
