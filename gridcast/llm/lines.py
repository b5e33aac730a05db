"""Line deduplication by a deletion-neighbourhood join.

Lines are compared lower-cased with single spaces. A line of ``MIN_CHARS`` characters or more goes where an
earlier line (by document id, text hash, line number) is within one edit of it: one character put in, taken out or
changed. Shorter lines always stay.

Equal lines are collapsed first. Of the distinct lines only those that share about a half with another can be within one edit
(an edit leaves the first or the last part of somewhat under half the length as it was; lengths are rounded down to classes for
that, and a line whose length opens a class also takes the one below, so that parts meet across an insertion). Of these, only lines
that agree with another but for one sixteenth remain. They emit their deletion neighbourhood as hashed keys, at the
positions within those sixteenths: the line without character i (which equals a line that is one shorter) and the line with
character i blanked (which equals another line of the same length blanked there). Lines of one key are within one edit of
each other, so each is compared with the earliest of its key only: rows stay linear in the keys whatever the
size of a group, and no pair is emitted twice. The edit distance of each found pair is verified on the text.

Text is shuffled only for documents that hold a candidate or a removed line: a bitmap of hashed ids of fixed size
(1 MB) tells the rest apart, which pass by. All groupings are by key hash with partial aggregation; no group is collected but the lines of
one document.

Results: null texts stay null and have no lines; an empty text is one empty line; an empty table gives an empty result. Null ids come first. Rows
that agree in id and text tie: neither removes the other's lines. Very long texts are read whole, a line of any length is compared whole. Other
columns are kept whatever their names, but for ``lines_total`` and ``lines_removed``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mark_seen, materialize, private, seen_bitmap, table

MIN_CHARS = 20
BLOCKS = 16
BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def within_one(a: str, b: str) -> bool:
    """Is the edit distance one or less?"""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return short[i:] == long[i + 1 :]


def _hash(kind: int, n: int, text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 4 * n + kind)


def part_of(n: int) -> int:
    """The length of the first and last part that lines of about ``n`` characters are met by: the same for a range of lengths."""
    return (n >> max(0, n.bit_length() - 4) << max(0, n.bit_length() - 4)) // 2


def half_keys(line: str) -> list[int]:
    """Keys of the first and the last part (their lowest bit tells which), for the line's class and, at its edge, the class below."""
    n = len(line)
    sizes = [part_of(n)] + ([part_of(n - 1)] if part_of(n - 1) != part_of(n) else [])
    return [k for p in sizes for k in (_hash(0, p, line[:p]) & ~1, _hash(1, p, line[n - p :]) | 1)]


def block_keys(line: str) -> list[tuple[int, int, int]]:
    """(key, first, end): the line without each of its ``BLOCKS`` parts, and the positions in that part; for its length and one less."""
    n, out = len(line), []
    for m in (n, n - 1):
        for j in range(BLOCKS):
            a, e = j * m // BLOCKS, (j + 1) * m // BLOCKS
            end = n - m + e
            if end > a:
                out.append((_hash(3, m * BLOCKS + j, line[:a] + "\0" + line[end:]), a, end))
    return out


def neighbourhood(line: str, ranges: list[tuple[int, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Keys of the whole line, of the line without a character, and of the line with one blanked, at positions in the ranges."""
    n = len(line)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    terms = codes * power
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
    at = np.unique(np.concatenate([np.arange(lo, hi) for lo, hi in ranges]))
    without = prefix[at] + (prefix[n] - prefix[at + 1]) * np.uint64(INVERSE)
    blanked = prefix[n] - terms[at] + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    def mix(x, size, kind):
        x = (x ^ np.uint64(2 * size + kind)) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))

    return int(mix(prefix[n : n + 1], n, 0)[0]), np.unique(mix(without, n - 1, 0)), np.unique(mix(blanked, n, 1))


def line_hash(line: str) -> bytes:
    """A line's identity: 128 bits, as 64 would meet by chance among 10^10 lines."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, line, h, k): every line long enough, its hash and its half keys. ``docs``: _id, _th, _text."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("h", pa.binary()), *((f"k{i}", pa.int64()) for i in range(4))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for i, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars and len(s := normal(line)) >= min_chars:
                        keys = [_signed(k) for k in half_keys(s)]
                        out.append((doc, th, i, line_hash(s), *keys, *[None] * (4 - len(keys))))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select("_id", "_th", "_text").mapInArrow(run, "id long, th long, line int, h binary, k0 long, k1 long, k2 long, k3 long")


def _texts(cands: DataFrame) -> DataFrame:
    """(h, norm) of the candidate lines of each text. ``cands``: _text, lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                lines, own = text.as_py().split("\n"), wanted.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([w["h"] for w in own], pa.binary()), pa.array([normal(lines[w["line"]]) for w in own], pa.string())], ["h", "norm"])

    return cands.select("_text", "lines").mapInArrow(run, "h binary, norm string")


def _blocks(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(h, _signed(k), a, e) for h, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, a, e in block_keys(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate([pa.binary(), pa.int64(), pa.int32(), pa.int32()])], ["h", "key", "lo", "hi"])

    return texts.select("h", "norm").mapInArrow(run, "h binary, key long, lo int, hi int")


def _keys(texts: DataFrame) -> DataFrame:
    """(h, key, kind): 0 the whole line, 1 without a character, 2 with one blanked. ``texts``: h, norm, ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, s, ranges in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                whole, without, blanked = neighbourhood(s, [(r["lo"], r["hi"]) for r in ranges])
                keys = np.concatenate((np.array([whole], np.uint64), without, blanked)).view(np.int64)
                kinds = np.concatenate(([0], np.ones(len(without)), np.full(len(blanked), 2))).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(keys), pa.binary()), pa.array(keys), pa.array(kinds)], ["h", "key", "kind"])

    return texts.select("h", "norm", "ranges").mapInArrow(run, "h binary, key long, kind byte")


def _met(keys: DataFrame) -> DataFrame:
    """The keys that two different lines (h) have."""
    return keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")


def removals(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, gone): the numbers of the lines that go, for each document that loses any. ``docs``: _id, _th, _text."""
    occ = materialize(occurrences(docs, min_chars), "lines", scan=True)
    # Smallest position and any half keys of each distinct line; a struct of the position first makes it one minimum.
    distinct = materialize(occ.groupBy("h").agg(F.min(F.struct("id", "th", "line", "k0", "k1", "k2", "k3")).alias("x"), F.count(F.lit(1)).alias("n")).select("h", F.struct("x.id", "x.th", "x.line").alias("pos"), "n", F.array("x.k0", "x.k1", "x.k2", "x.k3").alias("k")), "distinct-lines")
    halves = distinct.select("h", F.explode("k").alias("key")).filter("key IS NOT NULL")
    shared = _met(halves)
    cands = materialize(halves.join(shared, "key").select("h").distinct().join(distinct.select("h", "pos"), "h"), "line-candidates")

    per_doc = cands.groupBy(F.col("pos.id").alias("id"), F.col("pos.th").alias("th")).agg(F.collect_list(F.struct(F.col("pos.line").alias("line"), "h")).alias("lines"))
    few = mark_seen(docs, seen_bitmap(per_doc, "th"), F.col("_th")).filter("_seen").drop("_seen")
    # One of several rows that agree in id and text stands for all.
    found = few.join(per_doc, (F.col("_id").eqNullSafe(F.col("id"))) & (F.col("_th") == F.col("th"))).groupBy("id", "th").agg(F.first("_text").alias("_text"), F.first("lines").alias("lines"))
    texts = materialize(_texts(found), "line-texts")
    blocks = materialize(_blocks(texts), "line-blocks")
    close = blocks.join(_met(blocks), "key").groupBy("h").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    keys = materialize(_keys(texts.join(close, "h")), "line-keys")
    placed = keys.join(_met(keys), "key").join(cands.select("h", "pos"), "h")
    low = placed.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, F.struct("pos", "h"))).alias("whole"),
        F.min(F.when(F.col("kind") == 1, F.struct("pos", "h"))).alias("without"),
        F.min(F.when(F.col("kind") == 2, F.struct("pos", "h"))).alias("blanked"),
    )
    # A whole line meets the lines that are one longer, those meet it, and blanked lines meet each other.
    met = F.when(F.col("kind") == 0, F.col("without")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("blanked"))
    pairs = placed.join(low, "key").select("h", "pos", met.alias("met")).filter("met IS NOT NULL AND met.pos < pos AND met.h <> h").select("h", F.col("met.h").alias("other")).distinct()
    checked = pairs.join(texts, "h").join(texts.select(F.col("h").alias("other"), F.col("norm").alias("earlier")), "other")
    near = checked.filter(F.levenshtein("norm", "earlier", 1) >= 0).select("h").distinct().withColumn("near", F.lit(True))

    # Written out, so that the join below reads two exchanges and a line that very many documents have is split over tasks.
    affected = materialize(distinct.select("h", "pos", "n").join(near, "h", "left").filter("n > 1 OR near").select("h", "pos", F.coalesce("near", F.lit(False)).alias("near")), "affected-lines")
    gone = occ.select("id", "th", "line", "h").join(affected, "h").filter(F.col("near") | ~F.struct("id", "th", "line").eqNullSafe(F.col("pos")))
    return gone.groupBy("id", "th").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the remaining lines as text, and the columns ``lines_total`` and ``lines_removed``."""
    text = F.col(text_col).cast("string")
    docs = docs.drop("lines_total", "lines_removed")
    p = private(docs)
    keyed = docs.withColumn(f"{p}th", F.xxhash64(text))
    found = removals(docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text")), min_chars)
    gone = materialize(found, "line-removals").withColumnsRenamed({"id": f"{p}gid", "th": f"{p}gth", "gone": f"{p}gone"})
    marked = mark_seen(keyed, seen_bitmap(gone, f"{p}gth"), F.col(f"{p}th"), f"{p}seen")
    own = F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}gid")) & (F.col(f"{p}th") == F.col(f"{p}gth"))
    joined = marked.filter(F.col(f"{p}seen")).join(gone, own, "left").drop(f"{p}gid", f"{p}gth")
    both = joined.unionByName(marked.filter(~F.col(f"{p}seen")).withColumn(f"{p}gone", F.lit(None).cast("array<int>"))).drop(f"{p}th", f"{p}seen")
    names = [*docs.columns, "lines_total", "lines_removed"]
    schema = T.StructType(list(docs.schema.fields)).add("lines_total", "long").add("lines_removed", "long")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for value, drop in zip(batch.column(at), batch.column(len(names) - 2), strict=True):
                text = value.as_py()
                if text is None or not drop.is_valid:
                    texts.append(text)
                    total.append(0 if text is None else text.count("\n") + 1)
                    removed.append(0)
                    continue
                lines, out = text.split("\n"), set(drop.as_py())
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in out))
                total.append(len(lines))
                removed.append(len(out))
            cols = [batch.column(i) for i in range(len(names) - 2)]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names)

    return both.mapInArrow(run, schema)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the hash of what remains, for all documents."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
