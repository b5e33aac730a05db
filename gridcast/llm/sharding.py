"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` equal cells. Every shard owns ``vnodes`` virtual nodes at cells drawn by a hash of
(shard, node); a cell belongs to the next virtual node clockwise. A shard's capacity is its exact share of
the rows, so counts differ by one at most: where a shard is full, the remaining keys of a cell continue
clockwise to the next shard with room. Adding a shard moves the keys it takes over and those which overflow
differently, not the rest.

Only DataFrame and SQL functions touch rows. The rows of a cell are ranked by key hash; per-cell counts (at
most ``cells`` rows, whatever the input) give rank ranges per shard, and these come back as a broadcast
lookup of at most ``cells`` + 2 * ``shards`` * ``vnodes`` rows. Repeated rows are counted before the ranking, so that
a row held a third of the time is ranked once; its copies get their ranges of slots first and are made from these in chunks of ``CHUNK``,
which are dealt evenly, so no task holds them all.

Nulls: a null text counts as empty, a null key is a key like any other. Very long texts enter by size and checksum. Rows that agree in key, size and
checksum are copies and take neighbouring slots. An empty table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

SHARDS = 8
VNODES = 64
CELLS = 4096
CHUNK = 1 << 14


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[int]:
    """The shard of the virtual node at each cell of the ring, -1 where there is none."""
    if shards * vnodes > cells // 2:
        raise ValueError("more virtual nodes than half the cells")
    at = [-1] * cells
    for node in range(vnodes):
        for shard in range(shards):
            cell = int.from_bytes(hashlib.md5(f"{shard}/{node}".encode()).digest()[:8], "big") % cells
            while at[cell] >= 0:
                cell = (cell + 1) % cells
            at[cell] = shard
    return at


def assign_cells(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) for the rows of each cell, with bounded loads."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    at = ring(shards, vnodes, cells)
    after = [c for c in range(cells) if at[c] >= 0]
    plan = []
    for cell in sorted(counts):
        lo, left = 0, counts[cell]
        start = next((i for i, c in enumerate(after) if c >= cell), 0)
        for step in range(len(after)):
            if not left:
                break
            shard = at[after[(start + step) % len(after)]]
            if take := min(left, room[shard] - used[shard]):
                plan.append((cell, lo, lo + take, shard, used[shard]))
                used[shard] += take
                lo, left = lo + take, left - take
    return plan


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """One row for each distinct (id, size, checksum), with its number of copies and its place on the ring."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.octet_length(text)).cast("long").alias("_bytes"),
        F.crc32(text).alias("text_crc32"),
    ).select("doc_id", (F.col("_bytes") + 1).alias("size"), "text_crc32")
    point = F.xxhash64("doc_id", "text_crc32", "size")
    return rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n")).withColumn("_point", point).withColumn("_cell", F.pmod(F.col("_point"), F.lit(cells)).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, cells: int = CELLS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in a shard) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col, cells)
    counts = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.sum("_n").alias("n")).collect()}  # at most `cells` rows
    plan = assign_cells(counts, shards, vnodes, cells) or [(-1, 0, 0, 0, 0)]
    values = ",".join(f"({c},{lo}L,{hi}L,{s},{base}L)" for c, lo, hi, s, base in plan)
    ranges = spark.sql(f"SELECT * FROM VALUES {values} AS t(_cell, _lo, _hi, shard, _base)")
    order = Window.partitionBy("_cell").orderBy("_point", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("_end", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.greatest(F.col("_end") - F.col("_n"), F.col("_lo")), F.least("_end", "_hi")
    met = ranked.join(F.broadcast(ranges), "_cell").withColumns({"_first": first, "_last": last}).filter("_first < _last")
    held = met.select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_first") - F.col("_lo")).alias("_slot"), (F.col("_last") - F.col("_first")).alias("_n"))
    chunks = held.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk)))).hint("rebalance")
    at = F.explode(F.sequence(F.col("_chunk") * chunk, F.least(F.col("_n"), (F.col("_chunk") + 1) * chunk) - 1))
    return chunks.withColumn("_at", at).select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_at")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards under the law ``rows``."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
