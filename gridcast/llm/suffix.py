"""Substring deduplication with suffix arrays: bytes covered by a 200-byte string that also starts anywhere else.

Suffix arrays are built per shard, by Larsson-Sadakane refinement in numpy (groups of equal prefixes are
sorted by the rank behind them, doubling the prefix, and only groups not yet told apart are touched), with
Kasai's common prefixes; suffix arrays of different shards are merged by binary search.

What makes the shards small is an exact filter. A string of ``LENGTH`` bytes is represented by its anchor, the 16-byte
gram of the smallest hash in it (the leftmost of equal ones), which depends on the string alone; the strings of a text
that share an anchor are consecutive and form one *context*. Equal strings have equal anchors at equal offsets, so only
contexts whose anchor gram occurs at two places of the corpus can hold a repeat, and
anchors decide the shard: contexts of an anchor meet in one shard. Equal contexts are counted before they are dealt (all their strings
repeat) and go to the shard once, equal texts likewise; so a passage or text that a third of all documents share costs one
context. An anchor with more than ``SHARD`` bytes of different contexts is dealt as blocks: each block gets
its suffix array, and for each two blocks the strings of one are searched in the array of the other. Within a shard, contexts enter the array
only if they share their anchor with the 92 bytes before or behind it, as any two that share a string do.

Only hashes travel for the whole corpus (about one row of 36 bytes in 90 bytes of text); text is shuffled for documents that
hold a context to compare or a byte to remove (a bitmap of fixed size tells the others apart).

Results: a null text counts as empty. Texts shorter than ``LENGTH`` keep everything. Matches never cross
documents. Repeated rows and equal texts are copies of each other, whatever their ids. Very long texts are hashed
in overlapping slices. An empty table gives an empty result. Other columns are
kept whatever their names, but for ``removed_spans``, ``kept_bytes`` and ``text_bytes``, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mark_seen, materialize, private, seen_bitmap, table

LENGTH = 200
GRAM = 16
SHARD = 1 << 20
SLICE = 4 << 20
BITS = 9  # of a symbol: 0 ends a context, a byte is one more
PACK = 7  # symbols in a word


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes at each position."""
    w = data.astype(np.uint64)
    for half in (1, 2, 4):
        w = w[:-half] | w[half:] << np.uint64(8 * half)
    x = w[:-8] * np.uint64(0x9E3779B97F4A7C15) + (w[8:] ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of the runs of strings with one anchor, and (as hash order) the anchor's place is implied by the content."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none
    wide = length - GRAM + 1
    if len(data) > SLICE + length:
        parts = [(at, anchors(data[at : at + SLICE + length - 1], length)) for at in range(0, len(data) - length + 1, SLICE)]
        return np.concatenate([p[0] for _, p in parts]), np.concatenate([p[1] + at for at, p in parts]), np.concatenate([p[2] + at for at, p in parts])
    h = gram_hashes(data)
    n = len(h)
    key = np.full(-(-n // wide) * wide, ~np.uint64(0))
    key[:n] = h & ~np.uint64((1 << 24) - 1) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - wide + 1
    place = (np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return h[place[cut]], cut, np.concatenate((cut[1:], [starts])) - 1


def symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The contexts as symbols with an end mark each, and where each starts."""
    size = np.array([len(p) for p in parts])
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    sym = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    sym[start + size] = 0
    return sym, start


def packed(sym: np.ndarray) -> np.ndarray:
    """The next seven symbols of each position in one word, comparable as integers."""
    padded = np.concatenate((sym, np.zeros(PACK - 1, np.int64)))
    out = np.zeros(len(sym), np.int64)
    for k in range(PACK):
        out = out << BITS | padded[k : k + len(sym)]
    return out


def suffix_array(word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, place, shared) of all positions, told apart by their first ``depth`` symbols at least; ``word``: packed symbols.

    ``shared`` counts symbols that a suffix is known to share with its predecessor: the prefix length before the round that told them
    apart, which is over half of what they share, or all of the last round's where none did.
    """
    n = len(word)
    sa = np.argsort(word)
    new = np.concatenate(([True], word[sa[1:]] != word[sa[:-1]]))
    rank = np.zeros(n + 1, np.int64)  # the first place of a group, plus one; the end of the text has rank 0
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    shared = np.zeros(n, np.int64)
    h = PACK
    while True:
        at = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))  # places of groups not yet told apart
        shared[at[~new[at]]] = h
        if h >= depth or not len(at):
            break
        own = sa[at]
        key = rank[own] * (n + 1) + rank[np.minimum(own + h, n)]
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[at] = own
        new[at] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[own] = np.maximum.accumulate(np.where(new[at], at + 1, 0))
        h *= 2
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    return sa, place, shared


def common_prefixes(word: np.ndarray, sa: np.ndarray, place: np.ndarray, shared: np.ndarray, cap: int, least: int = 0, lanes: int = 4096) -> np.ndarray:
    """Kasai: the common prefix of each suffix with its predecessor in the array, up to ``cap`` symbols.

    Text positions are walked in order; each starts from the last position's length less one (which holds where the refinement told
    that pair apart, as their order is then that of the whole suffixes) or from ``shared``, whichever is more. ``lanes`` stretches of the
    text are walked side by side. Where the refinement shows less than ``least`` symbols, its bound is left as it is.
    """
    n = len(sa)
    padded = np.concatenate((word, np.zeros(cap + PACK, np.int64)))
    known = np.minimum(shared, cap)[place]
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    open_ = np.flatnonzero((known < cap) & (before >= 0) & (np.maximum(2 * known, PACK) > least))
    out = known
    if not len(open_):
        return out[sa]
    lanes = max(1, min(lanes, len(open_) // 64))
    edge = np.linspace(0, len(open_), lanes + 1).astype(np.int64)
    at, end = edge[:-1].copy(), edge[1:]
    last, length = np.full(lanes, -2), np.zeros(lanes, np.int64)
    shifts = np.arange(PACK - 1, -1, -1) * BITS
    for _ in range(int((end - at).max(initial=0))):
        live = np.flatnonzero(at < end)
        i = open_[at[live]]
        j = before[i]
        k = np.maximum(out[i], np.where(last[live] == i - 1, length[live] - 1, 0))
        run = np.flatnonzero(k < cap)
        while len(run):
            x = padded[i[run] + k[run]] ^ padded[j[run] + k[run]]
            same = x == 0
            k[run[same]] += PACK
            if not same.all():
                k[run[~same]] += ((x[~same][:, None] >> shifts) == 0).sum(1)
            run = run[same]
            run = run[k[run] < cap]
        k = np.minimum(k, cap)
        out[i] = k
        last[live], length[live] = i, k
        at[live] += 1
    return out[sa]


def partnered(hashes: list[int], parts: list[bytes], length: int = LENGTH) -> list[int]:
    """The contexts that can share a string with another: a shared string holds the anchor and half of the rest before or behind it."""
    half = (length - GRAM) // 2
    joined = np.frombuffer(b"\0".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    want = np.repeat(np.array(hashes, np.int64).view(np.uint64), size + 1)[: len(joined) - GRAM + 1]
    hit = np.flatnonzero(gram_hashes(joined) == want)
    owner = np.searchsorted(start, hit, "right") - 1
    cores: dict[tuple, int] = {}
    mine: list[set] = [set() for _ in parts]
    for k, at in zip(owner.tolist(), (hit - start[owner]).tolist(), strict=True):
        for core in ((hashes[k], 0, parts[k][at - half : at]) if at >= half else None, (hashes[k], 1, parts[k][at + GRAM : at + GRAM + half]) if at + GRAM + half <= len(parts[k]) else None):
            if core is not None and core not in mine[k]:
                mine[k].add(core)
                cores[core] = cores.get(core, 0) + 1
    return [k for k, own in enumerate(mine) if any(cores[c] > 1 for c in own)]


def repeated(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For each symbol of ``symbols(parts)``: does a string of ``length`` start here that also starts at another place of the shard?"""
    sym, _ = symbols(parts)
    word = packed(sym)
    sa, place, shared = suffix_array(word, length)
    lcp = common_prefixes(word, sa, place, shared, length, least=length)
    long = lcp >= length
    hit = long | np.concatenate((long[1:], [False]))
    out = np.zeros(len(sym), bool)
    out[sa] = hit
    return out & starts_of(parts, length)


def starts_of(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Where a string of ``length`` lies within its context."""
    size = np.array([len(p) for p in parts])
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    step = np.zeros(int((size + 1).sum()) + 1, np.int64)
    long = size >= length
    np.add.at(step, start[long], 1)
    np.add.at(step, start[long] + size[long] - length + 1, -1)
    return np.cumsum(step[:-1]) > 0


def _narrow(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, sorted_at, right: bool) -> np.ndarray:
    """Binary search of each value between its own bounds; ``sorted_at`` gives the sorted value at a place."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        on = np.flatnonzero(lo < hi)
        if not len(on):
            return lo
        mid = (lo[on] + hi[on]) // 2
        v = sorted_at(mid)
        up = v <= value[on] if right else v < value[on]
        lo[on[up]] = mid[up] + 1
        hi[on[~up]] = mid[~up]


def merged(one: list[bytes], two: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """As ``repeated``, for strings of one shard that also start in the other: each string of ``one`` is searched in the suffix array of ``two``."""
    (a, _), (b, _) = symbols(one), symbols(two)
    wa, wb = packed(a), packed(b)
    sa, _, _ = suffix_array(wb, length)
    starts_b = starts_of(two, length)
    sa = sa[starts_b[sa]]
    query = np.flatnonzero(starts_of(one, length))
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(sa))
    full = length // PACK * PACK
    for depth in [*range(0, full, PACK), *([length - PACK] if length % PACK else [])]:
        value = wa[query + depth]
        at = lambda p, d=depth: wb[sa[p] + d]
        lo, hi = _narrow(value, lo, hi, at, False), _narrow(value, lo, hi, at, True)
        keep = lo < hi
        query, lo, hi = query[keep], lo[keep], hi[keep]
    hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    hit_a[query] = True
    step = np.zeros(len(sa) + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    hit_b[sa[np.cumsum(step[:-1]) > 0]] = True
    return hit_a, hit_b


def _runs(hit: np.ndarray, parts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each context the ranges of string starts, first and last, that are set in ``hit``."""
    _, start = symbols(parts)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    first, last = edge[::2], edge[1::2] - 1
    own = np.searchsorted(start, first, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    for k, f, t in zip(own.tolist(), (first - start[own]).tolist(), (last - start[own]).tolist(), strict=True):
        out[k].append((f, t))
    return out


def contexts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(h, c, t, a, b): anchor hash, context hash, text key, first and last start. ``docs``: _t, _data."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out: list[tuple] = []
            rows = 0

            def flush(own):
                h, c, t, a, b = (np.concatenate(x) for x in zip(*own, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], schema=schema)

            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py() or b""
                if len(data) < length:
                    continue
                h, a, b = anchors(np.frombuffer(data, np.uint8), length)
                c = np.fromiter((xxh64_intdigest(data[i:j]) for i, j in zip(a.tolist(), (b + length).tolist(), strict=True)), np.uint64, len(a))
                out.append((h, c, np.full(len(h), key), a, b))
                rows += len(h)
                if rows > 100_000:
                    yield flush(out)
                    out, rows = [], 0
            if out:
                yield flush(out)

    return docs.select("_t", "_data").mapInArrow(run, "h long, c long, t long, a int, b int")


def _cut(rows: DataFrame) -> DataFrame:
    """(h, c, grp, side, data): the bytes of each context to compare. ``rows``: _data, want (array of h, c, a, b, grp, side)."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("grp", pa.int64()), ("side", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, want in zip(batch.column(0), batch.column(1), strict=True):
                data, own = value.as_py(), want.as_py()
                cols = [[w["h"] for w in own], [w["c"] for w in own], [w["grp"] for w in own], [w["side"] for w in own], [data[w["a"] : w["b"]] for w in own]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.select("_data", "want").mapInArrow(run, "h long, c long, grp long, side int, data binary")


def _compare(parts: DataFrame, length: int) -> DataFrame:
    """(h, c, runs): ranges of repeating strings within each context, found in its groups of one shard or two blocks."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("runs", pa.list_(pa.struct([("f", pa.int32()), ("l", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: list, runs: list):
            found = [(k, r) for k, r in zip(keys, runs, strict=True) if r]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([[{"f": f, "l": t} for f, t in r] for _, r in found], schema.field(2).type)], schema=schema)

        def flush(own: list):
            for side in sorted({r[3] for r in own}):
                if side == 1:
                    continue
                keys = [(r[0], r[1]) for r in own if r[3] == side]
                data = [r[4] for r in own if r[3] == side]
                if side == 2:
                    able = partnered([k[0] for k in keys], data, length)
                    if able:
                        keys, data = [keys[k] for k in able], [data[k] for k in able]
                        yield emit(keys, _runs(repeated(data, length), data))
                else:
                    keys2 = [(r[0], r[1]) for r in own if r[3] == 1]
                    data2 = [r[4] for r in own if r[3] == 1]
                    if data2:
                        hit, hit2 = merged(data, data2, length)
                        yield emit(keys, _runs(hit, data))
                        yield emit(keys2, _runs(hit2, data2))

        held: list = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if held and held[-1][2] != row[2]:
                    yield from flush(held)
                    held = []
                held.append(row)
        if held:
            yield from flush(held)

    return parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "h long, c long, runs array<struct<f:int,l:int>>")


def text_keys(data: DataFrame) -> tuple[list[int], DataFrame]:
    """Text hashes (of ``_data``) that different texts share, and (t, n, k) of every text: key, bytes and copies.

    Length and checksum tell such texts apart; their keys are hashed once more (see ``text_key``). About one hash
    is shared among 2^32 texts, so the list stays short at any size.
    """
    shared: list[int] = []
    while True:
        texts = data.groupBy(text_key("_data", shared).alias("t"), F.octet_length("_data").cast("long").alias("n"), F.crc32("_data").alias("crc")).agg(F.count(F.lit(1)).alias("k"))
        texts = materialize(texts, "texts")
        more = [r["t"] for r in texts.groupBy("t").count().filter("count > 1").collect()]
        if not more:
            return shared, texts.drop("crc")
        shared += more


def text_key(data, shared: list[int]) -> F.Column:
    key = F.xxhash64(data)
    for k in shared:
        key = F.when(key == k, F.xxhash64(F.lit(k), data)).otherwise(key)
    return key


def spans(docs: DataFrame, texts: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(t, spans): byte ranges to remove, not yet merged, for each text that has any. ``docs``: _t, _data; ``texts``: t, n, k."""
    found = materialize(contexts(docs, length), "contexts", scan=True)
    place = F.xxhash64("t", "a")
    twice = found.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select("h")
    again = materialize(found.join(twice, "h"), "repeated-contexts")

    kinds = again.groupBy("h", "c").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.min(F.struct("t", "a", "b")).alias("one")).select("h", "c", (F.col("x") != F.col("y")).alias("many"), "one")
    size = F.sum(F.col("one.b") - F.col("one.a") + length)
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m"), size.alias("bytes")).filter("m > 1").select("h", "bytes")
    compare = materialize(kinds.join(mixed, "h"), "contexts-to-compare")
    total = compare.agg(F.sum(F.col("one.b") - F.col("one.a") + length)).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    blocks = F.ceil(F.col("bytes") / shard).cast("int")
    mine = F.pmod(F.col("c"), blocks).cast("int")
    small = F.col("bytes") <= shard
    other = F.explode(F.sequence(F.lit(0), F.when(small, 0).otherwise(blocks - 1)))
    dealt = compare.withColumn("mine", F.when(small, 0).otherwise(mine)).withColumn("other", other).select(
        F.col("one.t").alias("t"),
        F.struct(
            "h", "c", F.col("one.a").alias("a"), (F.col("one.b") + length).alias("b"),
            F.when(small, F.pmod("h", F.lit(shards))).otherwise(F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other"))).cast("long").alias("grp"),
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
        ).alias("w"),
    )
    per_text = dealt.groupBy("t").agg(F.collect_list("w").alias("want"))
    few = mark_seen(docs, seen_bitmap(compare.select(F.col("one.t").alias("t")), "t"), F.col("_t")).filter("_seen")
    rows = few.join(per_text, F.col("_t") == F.col("t")).groupBy("_t").agg(F.first("_data").alias("_data"), F.first("want").alias("want"))
    runs = materialize(_compare(_cut(rows), length), "context-runs")

    whole = kinds.filter("many").select("h", "c", F.array(F.struct(F.lit(-1).alias("f"), F.lit(-1).alias("l"))).alias("runs"))
    marks = whole.unionByName(runs)
    first, last = F.col("a") + F.greatest("run.f", F.lit(0)), F.when(F.col("run.l") < 0, F.col("b")).otherwise(F.col("a") + F.col("run.l"))
    hits = again.join(marks, ["h", "c"]).select("t", "a", "b", F.explode("runs").alias("run")).select("t", first.alias("s"), (last + length).alias("e"))
    whole_texts = texts.filter(f"k > 1 AND n >= {length}").select("t", F.lit(0).alias("s"), F.col("n").cast("int").alias("e"))
    # Copies of a text repeat its ranges; they are dropped before the ranges of a text come together.
    return hits.unionByName(whole_texts).distinct().groupBy("t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge_spans(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, text_col: str = "text") -> DataFrame:
    """``docs`` with ``removed_spans`` (byte ranges), ``kept_bytes`` (what remains, as binary) and ``text_bytes``."""
    docs = docs.drop("removed_spans", "kept_bytes", "text_bytes")
    p = private(docs)
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    view = docs.select(data.alias("_data"))
    shared, texts = text_keys(view)
    view = view.withColumn("_t", text_key("_data", shared))
    found = materialize(spans(view, texts, length, shard), "spans").withColumnsRenamed({"t": f"{p}st", "spans": f"{p}spans"})
    keyed = docs.withColumn(f"{p}data", data).withColumn(f"{p}t", text_key(f"{p}data", shared))
    marked = mark_seen(keyed, seen_bitmap(found, f"{p}st"), F.col(f"{p}t"), f"{p}seen")
    touched = marked.filter(F.col(f"{p}seen")).join(found, F.col(f"{p}t") == F.col(f"{p}st"), "left")
    rest = marked.filter(~F.col(f"{p}seen")).withColumn(f"{p}spans", F.lit(None).cast("array<struct<s:int,e:int>>"))
    both = touched.select(*docs.columns, f"{p}data", f"{p}spans").union(rest.select(*docs.columns, f"{p}data", f"{p}spans"))
    span = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
    schema = T.StructType(list(docs.schema.fields)).add("removed_spans", span).add("kept_bytes", "binary").add("text_bytes", "long")
    names, width = [*docs.columns, "removed_spans", "kept_bytes", "text_bytes"], len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone, size = [], [], []
            for value, own in zip(batch.column(width), batch.column(width + 1), strict=True):
                raw = value.as_py()
                size.append(len(raw))
                merged_ = merge_spans([(x["s"], x["e"]) for x in own.as_py()]) if own.is_valid else []
                gone.append([{"s": s, "e": e} for s, e in merged_])
                at, out = 0, []
                for s, e in merged_:
                    out.append(raw[at:s])
                    at = e
                kept.append(b"".join([*out, raw[at:]]) if merged_ else raw)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], pa.array(gone, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.binary()), pa.array(size, pa.int64())], names)

    return both.mapInArrow(run, schema)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document, and the hash of the rest."""
    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    gone = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["s"])
    return rows.select("doc_id", F.col("text_bytes").alias("n_bytes"), gone.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
