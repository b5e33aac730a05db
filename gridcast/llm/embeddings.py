"""Embedding near-duplicates: Euclidean p-stable hashing of normalised vectors, then exact cosine checks.

Equal vectors are collapsed to one row with a count. Each distinct vector, normalised, is hashed in several tables: a
table's key is ``k`` Gaussian projections, shifted and quantised to cells of ``WIDTH``. At cosine ``threshold`` the
distance is sqrt(2 - 2 * threshold); ``k`` grows with the logarithm of the number of vectors, so that few vectors meet another by
chance at any size, and the number of tables follows from ``k`` so that a pair at the threshold is missed by
all of them with a chance of ``MISS`` at most (closer pairs: far less).

Only keys and ids are shuffled for all tables. A vector travels once to its keys that another vector has too, and from there
to the buckets of these keys alone. Buckets above ``BLOCK`` vectors are dealt as pairs of blocks to separate tasks, so no task holds a large bucket and no
pair is left out. A pair is counted in the first table where its keys agree, found from the shared keys that each row
carries, so link counts need no shuffle of pairs; per bucket the links are reduced to a spanning forest for the components.

Results: one row per vector; vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link. Ties and repeated rows are copies that link with each other; a null id
gets its component's smallest id, and is kept only where all ids of the component are null. Vectors may be of any length. An empty table gives an
empty result. Other columns are not read, whatever their names. Vectors are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components, local_stars

THRESHOLD = 0.95
WIDTH = 2.0
MISS = 0.01
CHANCE = 0.1  # chance neighbours of a vector in a table
BLOCK = 2000
SMALL = 12


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees, for vectors at this distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(count: int, threshold: float = THRESHOLD, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """(projections a table, tables) for so many distinct vectors."""
    k = max(6, round(math.log(max(2, count) / CHANCE) / -math.log(collision(math.sqrt(2), width))))
    near = collision(math.sqrt(max(1e-9, 2 - 2 * threshold)), width) ** k
    return k, math.ceil(math.log(miss) / math.log(1 - near)) if near < 1 else 1


def signatures(x: np.ndarray, k: int, tables: int, seed: int, width: float = WIDTH) -> np.ndarray:
    """The key of each vector in each table, as 32-bit hashes."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.normal(size=(x.shape[1], tables * k)), rng.uniform(0, width, tables * k)
    cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, k)
    mix = rng.integers(1, 1 << 62, k) | 1
    key = (cells * mix).sum(2)
    return ((key ^ (key >> 31)) & 0x7FFFFFFF).astype(np.int32)


def _encode(v: np.ndarray) -> bytes:
    """The vector in single precision where that is exact, else in double; the first byte is the width."""
    small = v.astype(np.float32)
    return b"\x04" + small.tobytes() if np.array_equal(small, v) else b"\x08" + v.tobytes()


def _decode(parts: list[bytes]) -> np.ndarray:
    """Normalised vectors (of one length) in double precision."""
    if len({len(p) for p in parts}) == 1:
        x = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)
        x = np.ascontiguousarray(x[:, 1:]).view(np.float32 if parts[0][0] == 4 else np.float64).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(p[1:], np.float32 if p[0] == 4 else np.float64).astype(np.float64) for p in parts])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pairs(x: np.ndarray, keys: np.ndarray, t: np.ndarray, group: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at or above the threshold in each group, in the first table where their keys agree.

    ``side`` tells the two blocks of a group apart (0 and 1); 2 means that the group is compared with itself.
    """
    first, second = [], []
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((cuts, [len(group)])))
    size_of = np.repeat(sizes, sizes)

    def own(i, j):
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[ok], j[ok]
        ok = (keys[i] == keys[j]).argmax(1) == t[i]
        first.append(i[ok])
        second.append(j[ok])

    for shift in range(1, min(SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero((group[shift:] == group[:-shift]) & (size_of[shift:] <= SMALL) & ((side[shift:] == 2) | (side[shift:] != side[:-shift])))
        for at in range(0, len(i), 1 << 15):
            own(i[at : at + (1 << 15)], i[at : at + (1 << 15)] + shift)
    for at, n in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        rows = np.arange(at, at + n)
        left, right = (rows, rows) if side[at] == 2 else (rows[side[rows] == 0], rows[side[rows] == 1])
        for lo in range(0, len(left), 512):
            i, j = np.nonzero(x[left[lo : lo + 512]] @ x[right].T >= threshold - 1e-9)
            i, j = left[lo + i], right[j]
            if side[at] == 2:
                i, j = i[i < j], j[i < j]
            for p in range(0, len(i), 1 << 15):
                own(i[p : p + (1 << 15)], j[p : p + (1 << 15)])
    none = np.zeros(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def links(distinct: DataFrame, threshold: float = THRESHOLD, seed: int = 0, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """(id, links, root) parts: linked vectors counted with their copies, and a forest edge id-root. ``distinct``: id, n, vec."""
    k, tables = shape(distinct.count(), threshold, miss=miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        tags = [xxh64_intdigest(str(t).encode()) for t in range(tables)]
        for batch in batches:
            vecs = [np.asarray(v, np.float64) for v in batch.column(2).to_pylist()]
            keys = np.zeros((len(vecs), tables), np.uint64)
            raw = [_encode(v) for v in vecs]
            for dim in {len(v) for v in vecs}:
                own = [i for i, v in enumerate(vecs) if len(v) == dim]
                cells = signatures(_decode([raw[i] for i in own]), k, tables, seed).astype(np.uint64)
                mixed = (cells + np.uint64(dim * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93) ^ np.array(tags, np.uint64)
                keys[own] = mixed ^ mixed >> np.uint64(32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * tables), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array([len(v) for v in vecs], pa.int32()), flat], ["id", "n", "raw", "dim", "keys"])

    signed = materialize(distinct.select("id", "n", "vec").mapInArrow(sign, "id long, n long, raw binary, dim int, keys array<long>"), "vector-keys")
    keyed = signed.select("id", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = keyed.join(sizes, "key").groupBy("id").agg(F.collect_list(F.struct("t", "key", "m")).alias("own"))  # `tables` entries at most
    large = signed.select("id", "n", "raw", "dim").join(shared, "id").withColumn("at", F.explode("own")).withColumn("blocks", F.ceil(F.col("at.m") / block).cast("int"))
    mine = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = large.withColumn("mine", mine).withColumn("other", other).select(
        F.xxhash64("at.key", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
        "id", "n", "raw", "dim", F.col("at.t").alias("t"), F.col("own.t").alias("ts"), F.col("own.key").alias("ks"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

        def flush(tab: pa.Table):
            for dim in pc.unique(tab["dim"]).to_pylist():
                part = tab.filter(pc.equal(tab["dim"], dim))
                num = lambda c: part[c].to_numpy()  # noqa: E731, B023
                x = _decode(part["raw"].to_pylist())
                # Keys that no other vector has differ from all others here as well.
                keys = np.repeat(-1 - np.arange(len(part), dtype=np.int64)[:, None], tables, 1)
                size = pc.list_value_length(part["ts"]).to_numpy()
                bare = lambda c: pc.list_flatten(part[c]).to_numpy()  # noqa: E731, B023
                keys[np.repeat(np.arange(len(part)), size), bare("ts")] = bare("ks")
                i, j = _pairs(x, keys, num("t"), num("grp"), num("side"), threshold)
                ids, n = num("id"), num("n")
                count = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
                used = np.flatnonzero(count)
                local = {p: q for q, p in enumerate(used.tolist())}
                roots = local_stars([local[p] for p in i.tolist()], [local[p] for p in j.tolist()], len(used))
                yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(count[used].astype(np.int64)), pa.array(ids[used[roots]] if len(used) else ids[used])], schema=schema)

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 30_000:
                tab = pa.Table.from_batches(held)
                grp = tab["grp"].to_numpy()
                end = int(np.searchsorted(grp, grp[-1]))
                if end:
                    yield from flush(tab.slice(0, end))
                held, rows = tab.slice(end).to_batches(), 0
        if held:
            yield from flush(pa.Table.from_batches(held))

    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.coalesce((F.size("vec") > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    # A vector's copies are one row; `id` numbers distinct vectors by a hash of their contents with the smallest id.
    sound = rows.filter(good)
    distinct = materialize(sound.groupBy("vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("id", F.xxhash64("vec", F.lit(1))), "vectors")
    parts = materialize(links(distinct.select("id", "n", "vec"), threshold, seed, block, miss), "vector-links")
    named = components(parts.select(F.col("id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("top"))
    counted = parts.groupBy("id").agg(F.sum("links").alias("links"))
    whole = distinct.select("id", "vec", "first", "n").join(named, "id", "left").withColumn("top", F.coalesce("top", "id")).join(counted, "id", "left")
    lowest = whole.groupBy("top").agg(F.min("first").alias("component_id"))
    found = whole.join(lowest, "top").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = sound.join(found, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
