"""Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups' roots, and a proof for every row.

Only digests move. Leaves (digests of whole rows) are written once and sorted by range over (group, id) into an RDD. A summary
of each partition (the count of its first and last group) gives the place of its first row within its group, so every partition knows the numbers of its
rows in the trees. It builds all complete aligned subtrees that lie within it; the ragged nodes at its boundaries, a few a level,
go by coordinate (group, block of ``ROUND`` levels) to be joined with those of its neighbours, block by block up to the roots. The groups' roots are the leaves
of one more tree, built the same way. Paths then come down: each ragged node learns the siblings above it, and each partition meets the paths of its own
nodes once more and completes the proofs of its rows.

The driver holds one summary a partition and the root. A partition has about ``ROWS`` leaves of 32 bytes; rows of one group, id and digest are told
apart by a row number, so a hot key is split like any other.

Results: nulls in any column enter the digest as ``-``; a null group is a group of its own, before all others; null ids come first in their group. Ties
(repeated ids) are ordered by digest; repeated rows are leaves of their own with proofs of their own. Rows with a null id are never tampered with. Texts of any length are
digested whole. An empty table gives an empty result. Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

ARITY = 3
ROUND = 6
ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Levels = list[tuple[int, list[bytes]]]


def field(value: F.Column) -> F.Column:
    """How a value enters a digest: ``-`` if null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def node(run: list[bytes]) -> bytes:
    """The digest (as hex text) of consecutive digests."""
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


def height(total: int, arity: int = ARITY) -> int:
    levels = 0
    while total > 1:
        total, levels = -(-total // arity), levels + 1
    return levels


def subtrees(leaves: list[bytes], first: int, total: int, arity: int = ARITY) -> Levels:
    """(first number, nodes) of each level above consecutive leaves of a tree of ``total``: the nodes all of whose leaves are among them."""
    levels = [(first, leaves)]
    while total > 1:
        at, own = levels[-1]
        end = at + len(own)
        lo, hi = -(-at // arity), end // arity if end < total else -(-total // arity)
        if hi <= lo:
            break
        levels.append((lo, [node(own[j * arity - at : (j + 1) * arity - at]) for j in range(lo, hi)]))
        total = -(-total // arity)
    return levels


def held(levels: Levels, level: int, number: int) -> bool:
    return level < len(levels) and levels[level][0] <= number < levels[level][0] + len(levels[level][1])


def ragged(levels: Levels, arity: int = ARITY) -> Iterator[tuple[int, int, bytes]]:
    """(level, number, digest) of the nodes whose parent is not among the levels: roots, and those at a boundary."""
    for level, (at, own) in enumerate(levels):
        lo, more = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for i in (range(len(own)) if not more else [*range(lo * arity - at), *range((lo + len(more)) * arity - at, len(own))]):
            yield level, at + i, own[i]


def step(run: list[bytes], at: int) -> bytes:
    """One level of a path: place in the run and number of siblings in a byte, then the siblings."""
    return bytes([at << 4 | len(run) - 1]) + b"".join(bytes.fromhex(d.decode()) for i, d in enumerate(run) if i != at)


def climb(levels: Levels, number: int, start: int = 0, arity: int = ARITY) -> tuple[bytes, int, int]:
    """The path of a node up to its highest ancestor among the levels, and that ancestor's level and number."""
    path, level = [], start
    while held(levels, level + 1, number // arity):
        at, own = levels[level]
        lo = number // arity * arity
        run = own[lo - at : lo + arity - at]
        path.append(step(run, number - lo))
        level, number = level + 1, number // arity
    return b"".join(path), level, number


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings as hex text) of each level."""
    at = 0
    while at < len(path):
        count = path[at] & 15
        yield path[at] >> 4, [path[at + 1 + 32 * i : at + 33 + 32 * i].hex().encode() for i in range(count)]
        at += 1 + 32 * count


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for place, others in steps(path):
        digest = node([*others[:place], digest, *others[place:]])
    return digest


def offsets(summaries: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """partition -> (number of its first row within its group, size of its first group, size of its last group).

    ``summaries``: (partition, first group, rows of it, last group, rows of it, groups) in the order of partitions, without empty ones.
    """
    sizes: list[int] = []
    place, before = {}, None
    for part, first, n_first, last, n_last, groups in summaries:
        if not sizes or first != before:
            sizes.append(0)
        place[part] = (sizes[-1], len(sizes) - 1)
        sizes[-1] += n_first
        if groups > 1:
            sizes.append(n_last)
        place[part] += (len(sizes) - 1,)
        before = last
    return {part: (at, sizes[a], sizes[b]) for part, (at, a, b) in place.items()}


def _segments(rows: Iterable, part: int, known: dict) -> Iterator[tuple[list, int, int]]:
    """(rows, number of the first, size of the group) of each group in a partition; ``rows``: (group, digest, ...) in order."""
    if part not in known:
        return
    place, head, tail = known[part]
    groups = groupby(rows, key=lambda r: r[0])
    own, nth = [*next(groups)[1]], 0
    while own:
        more = [*next(groups, (None, ()))[1]]
        yield own, 0 if nth else place, head if not nth else len(own) if more else tail
        own, nth = more, nth + 1


def ordered(leaves: DataFrame, order: list[str], rows: int = ROWS) -> RDD:
    """The leaves as an RDD sorted by range: (group, digest, *rest)."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // rows))
    keys = [F.col(c).asc_nulls_first() for c in order]
    return leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).rdd.map(tuple)


def summarise(rows: RDD) -> list[tuple]:
    """One summary a partition, see ``offsets``."""

    def one(part: int, own: Iterator) -> Iterator[tuple]:
        counts = [[g, sum(1 for _ in r)] for g, r in groupby(own, key=lambda r: r[0])]
        if counts:
            yield part, *counts[0], *counts[-1], len(counts)

    return sorted(rows.mapPartitionsWithIndex(one).collect(), key=lambda s: s[0])


NODES = "grp string, total long, level int, number long, digest binary, part int"
STEPS = "grp string, level int, number long, part int, path binary, up_level int, up_number long, total long, digest binary"


def boundary(rows: RDD, known: dict, arity: int = ARITY) -> DataFrame:
    """The ragged nodes of every partition."""
    spark = SparkSession.active()

    def local(part: int, own: Iterator) -> Iterator[tuple]:
        for segment, first, total in _segments(own, part, known):
            for level, number, digest in ragged(subtrees([r[1].hex().encode() for r in segment], first, total, arity), arity):
                yield segment[0][0], total, level, number, bytearray.fromhex(digest.decode()), part

    return materialize(spark.createDataFrame(rows.mapPartitionsWithIndex(local), NODES, verifySchema=False), "merkle-boundary")


def finish(nodes: DataFrame, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """(grp, digest) of every root, and (part, grp, level, number, path) of every ragged node, with its path to its root."""
    top = nodes.agg(F.max("total")).first()[0] or 1

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        total, goal = int(frame["total"].iat[0]), int(frame["goal"].iat[0])
        goal = min(goal, height(total, arity))
        have = {(int(a), int(b)): bytes(d).hex().encode() for a, b, d in zip(frame["level"], frame["number"], frame["digest"], strict=True)}
        size = total
        for level in range(goal):
            for number in {n // arity for own, n in have if own == level}:
                have[level + 1, number] = node([have[level, i] for i in range(number * arity, min((number + 1) * arity, size))])
            size = -(-size // arity)
        out = []
        for row in frame.itertuples():
            level, number, path = int(row.level), int(row.number), []
            while level < goal:
                size, lo = reduce(lambda n, _: -(-n // arity), range(level), total), number // arity * arity
                path.append(step([have[level, i] for i in range(lo, min(lo + arity, size))], number - lo))
                level, number = level + 1, number // arity
            out.append((row.grp, row.level, row.number, row.part, b"".join(path), level, number, total, bytes.fromhex(have[level, number].decode())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])

    powers = [arity**k for k in range(63) if arity**k < 1 << 63]
    tops = lambda total: reduce(F.Column.__add__, [(F.col(total) > p).cast("int") for p in powers])
    nodes = nodes.withColumn("done", F.col("level") == tops("total"))
    roots = nodes.filter("done").select("grp", "digest")
    paths = nodes.filter("done").select("part", "grp", "level", "number", F.lit(b"").alias("path"))
    rounds, carried = [], None
    for low in range(0, height(top, arity), ROUND):
        goal = low + ROUND
        own = nodes.filter(~F.col("done") & (F.col("level") >= low) & (F.col("level") < goal)).drop("done")
        if carried is not None:
            own = own.unionByName(carried)
        spans = ", ".join(f"{arity**k}L" for k in range(1, ROUND + 1))
        keyed = own.withColumns({"goal": F.lit(goal), "block": F.expr(f"number div element_at(array({spans}), {goal} - level)")})
        made = materialize(keyed.groupBy("grp", "block").applyInPandas(block, STEPS), "merkle-round")
        rounds.append(made)
        up = made.select("grp", "total", F.col("up_level").alias("level"), F.col("up_number").alias("number"), "digest").distinct()
        ended = F.col("level") == tops("total")
        roots = roots.unionByName(up.filter(ended).select("grp", "digest"))
        carried = up.filter(~ended).withColumn("part", F.lit(None).cast("int"))
    above = None
    for made in reversed(rounds):
        if above is None:
            full = made.select("part", "grp", "level", "number", "path")
        else:
            over = above.filter("part IS NULL").select(F.col("grp").alias("_g"), F.col("level").alias("_l"), F.col("number").alias("_n"), F.col("path").alias("_p"))
            met = made.join(over, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("up_level") == F.col("_l")) & (F.col("up_number") == F.col("_n")), "left")
            full = met.select("part", "grp", "level", "number", F.concat("path", F.coalesce("_p", F.lit(b""))).alias("path"))
        above = full
        paths = paths.unionByName(full.filter("part IS NOT NULL"))
    return roots, paths


def deliver(rows: RDD, known: dict, paths: DataFrame, emit: Callable[[tuple, bytes], tuple], arity: int = ARITY) -> RDD:
    """``emit(row, path)`` for every leaf: its path through its partition's subtrees and on by its highest node there. ``paths``: part, grp, level, number, path."""
    parts = rows.getNumPartitions()
    leaves = rows.mapPartitionsWithIndex(lambda part, own: (((part, 1, i), r) for i, r in enumerate(own)))
    above = paths.rdd.map(lambda r: ((r["part"], 0, 0), (r["grp"], r["level"], r["number"], bytes(r["path"]))))

    def complete(own: Iterator) -> Iterator[tuple]:
        for part, both in groupby(own, key=lambda kv: kv[0][0]):
            tails: dict = {}
            first = None
            for key, value in both:
                if key[1]:
                    first = value
                    break
                tails[value[:3]] = value[3]
            if first is None:
                continue

            def rest(both=both, first=first):
                yield first
                for _, value in both:
                    yield value

            for segment, at, total in _segments(rest(), part, known):
                levels = subtrees([r[1].hex().encode() for r in segment], at, total, arity)
                for i, row in enumerate(segment):
                    path, level, number = climb(levels, at + i, 0, arity)
                    yield emit(row, path + tails[row[0], level, number])

    return leaves.union(above).repartitionAndSortWithinPartitions(parts, lambda key: key[0]).mapPartitions(complete)


RESULT = "doc_id long, source string, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, rows: int = ROWS, arity: int = ARITY, proofs: bool = True) -> DataFrame:
    """doc_id, source, leaf, subroot, root, the proof (siblings' digests as text, from the leaf's level up; null without ``proofs``), its digest, and whether the row, tampered with or not, verifies."""
    if not 2 <= arity <= 15:
        raise ValueError("between 2 and 15 nodes make a run")
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("grp"), *[F.col(c).alias(f"f_{c}") for c in FIELDS])
    values = [F.col(f"f_{c}") for c in FIELDS]
    forged = leaf(*values[:-1], F.translate(values[-1].cast("string"), "\n", ""))
    tampered = F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0
    leaves = materialize(named.select("grp", leaf(*values).alias("digest"), "id", F.when(tampered, forged).alias("forged"), F.monotonically_increasing_id().alias("tie")), "merkle-leaves", scan=True)
    low = ordered(leaves, ["grp", "id", "digest", "tie"], rows)
    known = offsets(summarise(low))
    subroots, paths = finish(boundary(low, known, arity), arity)

    # The tree over the groups: the same again, with one group and the groups' roots as leaves.
    subroots = materialize(subroots, "merkle-subroots")
    upper = ordered(subroots.select(F.lit("").alias("all"), "digest", "grp"), ["all", "grp"], rows)
    upper_known = offsets(summarise(upper))
    top, upper_paths = finish(boundary(upper, upper_known, arity), arity)
    found = top.select("digest").first()
    root = bytes(found[0]).hex() if found else ""
    ends = deliver(upper, upper_known, upper_paths, lambda row, path: (row[2], bytearray(row[1]), bytearray(path)), arity)
    ends = materialize(spark.createDataFrame(ends, "_g string, subroot binary, tail binary", verifySchema=False), "merkle-ends")
    # A subroot stands before the siblings above it, so that leaves learn both from the path that reaches them.
    whole = paths.join(ends, F.col("grp").eqNullSafe(F.col("_g"))).select("part", "grp", "level", "number", F.concat("path", "tail", "subroot").alias("path"))

    def emit(row: tuple, path: bytes) -> tuple:
        group, digest, key, other = row[0], bytes(row[1]).hex(), row[2], row[3]
        path, subroot = path[:-32], path[-32:].hex()
        own = [d for _, others in steps(path) for d in others]
        folded = fold((bytes(other).hex() if other is not None else digest).encode(), path).decode()
        return key, group, digest, subroot, root, b"".join(own).decode() if proofs else None, node(own).decode(), folded, folded == root

    return spark.createDataFrame(deliver(low, known, whole, emit, arity), RESULT, verifySchema=False)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and which documents verify after tampering."""
    return manifest(table(spark, sf_dir, "documents"), proofs=False).drop("source", "proof")


SQL = r"""
WITH RECURSIVE
bits(n, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc(doc_id, s, i, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM documents
  UNION ALL SELECT doc_id, s, i + 1, xor(r.c // 256, b.c) FROM crc r JOIN bits b ON b.k = 8 AND b.n = xor(r.c % 256, CAST(ascii(substr(s, i, 1)) AS BIGINT)) WHERE i <= length(s)),
even AS (SELECT doc_id FROM crc WHERE i > length(s) AND xor(c, 4294967295) % 2 = 0),
leaves AS (
  SELECT doc_id, source, concat(
    CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
    CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head,
    CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS body,
    CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')) END AS bare,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM documents),
hashed AS (SELECT l.doc_id, source, idx, n, sha256(head || body) AS leaf, CASE WHEN e.doc_id IS NULL THEN sha256(head || body) ELSE sha256(head || bare) END AS used FROM leaves l LEFT JOIN even e ON l.doc_id = e.doc_id),
low(g, lvl, idx, n, h) AS (SELECT source, 0, idx, n, leaf FROM hashed UNION ALL SELECT g, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY g, lvl, idx // 3, n),
subs AS (SELECT g, h, lvl, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, idx, n, h) AS (SELECT 0, idx, n, h FROM subs UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 3, n),
runs AS (
  SELECT g, lvl, idx // 3 AS up, list(h ORDER BY idx) AS hs FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT s.g, s.lvl + t.lvl, t.up, t.hs FROM subs s JOIN (SELECT lvl, idx // 3 AS up, list(h ORDER BY idx) AS hs FROM high WHERE n > 1 GROUP BY ALL) t ON t.up = s.idx // CAST(pow(3, t.lvl + 1) AS BIGINT)),
walk(doc_id, g, lvl, idx, turn, folded, sib) AS (
  SELECT doc_id, source, 0, d.idx, s.lvl, used, '' FROM hashed d JOIN subs s ON d.source IS NOT DISTINCT FROM s.g
  UNION ALL
  SELECT w.doc_id, w.g, w.lvl + 1, w.up, w.turn,
    sha256(array_to_string(list_concat(list_concat(r.hs[1:w.at], [w.folded]), r.hs[w.at + 2:]), '')),
    concat(w.sib, array_to_string(list_concat(r.hs[1:w.at], r.hs[w.at + 2:]), ''))
  FROM (SELECT k.*, CASE WHEN k.lvl = k.turn THEN s.idx ELSE k.idx END AS here, here // 3 AS up, here % 3 AS at FROM walk k JOIN subs s ON k.g IS NOT DISTINCT FROM s.g) w
  JOIN runs r ON r.g IS NOT DISTINCT FROM w.g AND r.lvl = w.lvl AND r.up = w.up),
ends AS (SELECT doc_id, g, max_by(folded, lvl) AS folded, max_by(sib, lvl) AS sib FROM walk GROUP BY doc_id, g)
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(e.sib) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
FROM hashed d JOIN subs s ON d.source IS NOT DISTINCT FROM s.g JOIN ends e ON d.doc_id = e.doc_id CROSS JOIN (SELECT h FROM high WHERE n = 1) r
"""
