"""Outlines from way segments: ways in any order and direction become closed rings, and holes find the ring that they lie in.

Each way can be gone along in two directions. A direction's successor is the other way at its end, taken from there on; successors make cycles, each ring
twice, once in either direction. Pointer jumping finds the smallest way of each cycle (the ring's name, and the direction in which that way is gone
forwards is kept) and then how many points follow after each way, in as many rounds as the logarithm of the longest ring: no ring
is ever walked in one task. Ways that close no ring are left out; ends where more than two ways meet raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spatial import point_in_polygon, polygon_edges

KEYS = ["poly", "role"]
ROUNDS = 64


def _spread(df: DataFrame) -> DataFrame:
    """Joined by sorting: ways, points and rings grow with the input, and small as they look when compressed, a broadcast would hold them all in the driver."""
    return df.hint("merge")


def _ends(ways: DataFrame) -> DataFrame:
    """(poly, role, way, n, first and last point) of each way of two points or more."""
    point = F.struct("x", "y")
    found = ways.groupBy(*KEYS, "way").agg(F.count(F.lit(1)).alias("n"), F.min_by(point, "pos").alias("a"), F.max_by(point, "pos").alias("b"))
    return found.filter("n >= 2")


def _jump(now: DataFrame, columns: dict[str, F.Column], more: str) -> DataFrame:
    """Go from each ``nxt`` to its own, with ``columns`` made of a row's values and its successor's (``_o_{name}``), until none has a successor for which ``more`` holds."""
    from ..plans.checkpoint import cut

    for _ in range(ROUNDS):
        if now.filter(more).isEmpty():
            return now
        other = now.select(*KEYS, F.col("id").alias("nxt"), *[F.col(c).alias(f"_o_{c}") for c in now.columns if c not in (*KEYS, "id")])
        met = now.join(_spread(other), [*KEYS, "nxt"], "left").withColumns(columns)
        now = cut(met.select(*now.columns))
    raise RuntimeError("rings of more than 2^64 ways")


def order_ways(ways: DataFrame) -> DataFrame:
    """(poly, role, ring, way, forward, n, offset, size): the ways of each closed ring, where each begins among the ring's points, and the ring's size."""
    from ..plans.checkpoint import cut

    ends = cut(_ends(ways))
    closed = ends.filter("a = b").select(*KEYS, F.col("way").alias("ring"), "way", F.lit(True).alias("forward"), "n", F.lit(0).cast("long").alias("offset"), (F.col("n") - 1).alias("size"))
    both = ends.filter("a <> b").withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
    gone = both.select(*KEYS, (F.col("way") * 2 + F.col("d")).alias("id"), "n", F.when(F.col("d") == 0, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(F.col("d") == 0, F.col("b")).otherwise(F.col("a")).alias("e"))
    begun = gone.select(*KEYS, F.col("s").alias("e"), F.col("id").alias("nxt"))
    after = gone.join(_spread(begun), [*KEYS, "e"], "left").filter("nxt IS NULL OR nxt div 2 <> id div 2")
    single = F.assert_true(F.col("_m") <= 1, F.lit("more than two ways meet in a point"))
    after = after.groupBy(*KEYS, "id", "n").agg(F.min("nxt").alias("nxt"), F.count("nxt").alias("_m")).filter(single.isNull())
    # Directions without a successor end a chain that is no ring; those that lead to one have it taken out with them.
    start = cut(gone.select(*KEYS, "id", "n").join(_spread(after.select(*KEYS, "id", "nxt")), [*KEYS, "id"], "left"))
    number = start.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0  # a ring stays within an outline
    least = start.select(*KEYS, "id", "nxt", F.col("id").alias("low"), F.lit(1).cast("long").alias("steps"))
    # After as many steps as an outline has directions every direction of a cycle has met its smallest, and every chain has ended.
    least = _jump(least, {"low": F.least("low", F.coalesce("_o_low", "low")), "steps": F.col("steps") * 2, "nxt": F.col("_o_nxt")}, f"nxt IS NOT NULL AND steps <= {number}")
    rings = least.filter("nxt IS NOT NULL AND low % 2 = 0").select(*KEYS, "id", "low")
    kept = start.join(_spread(rings), [*KEYS, "id"]).withColumn("size", (F.col("n") - 1).cast("long"))
    total = kept.groupBy(*KEYS, "low").agg(F.sum("size").alias("total"))
    rest = cut(kept.select(*KEYS, "id", F.when(F.col("nxt") != F.col("low"), F.col("nxt")).alias("nxt"), F.col("size").alias("left")))
    rest = _jump(rest, {"left": F.col("left") + F.coalesce("_o_left", F.lit(0).cast("long")), "nxt": F.col("_o_nxt")}, "nxt IS NOT NULL")
    placed = kept.select(*KEYS, "id", "low", "n").join(_spread(rest.select(*KEYS, "id", "left")), [*KEYS, "id"]).join(_spread(total), [*KEYS, "low"])
    found = placed.select(*KEYS, F.expr("low div 2").alias("ring"), F.expr("id div 2").alias("way"), (F.col("id") % 2 == 0).alias("forward"), "n", (F.col("total") - F.col("left")).alias("offset"), F.col("total").alias("size"))
    return found.unionByName(closed)


def assemble(ways: DataFrame) -> DataFrame:
    """(poly, role, ring, pos, x, y): the vertices of the closed rings that the ways make, each once, from 0; ``ways``: poly, role, way (long), pos, x, y.

    Rings are named by their smallest way. Ways of one point are left out.
    """
    from ..plans.checkpoint import cut

    # Positions may have gaps: a point's place is its rank within its way, which is as long as an editor draws it.
    dense = ways.groupBy(*KEYS, "way").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("points")).select(*KEYS, "way", F.posexplode("points").alias("at", "p"))
    points = cut(dense.select(*KEYS, "way", F.col("at").alias("pos"), "p.x", "p.y"))
    met = points.join(_spread(order_ways(points)), [*KEYS, "way"])
    along = F.when(F.col("forward"), F.col("pos")).otherwise(F.col("n") - 1 - F.col("pos"))
    return met.withColumn("_at", along).filter(F.col("_at") < F.col("n") - 1).select(*KEYS, "ring", (F.col("offset") + F.col("_at")).alias("pos"), "x", "y")


def with_holes(rings: DataFrame) -> DataFrame:
    """(poly, outer, role, ring, pos, x, y): holes (role ``inner``) with the outer ring that contains them; holes outside all rings are left out.

    Even-odd crossing over an outline's rings then is the difference of its outer rings and its holes.
    """
    whole = rings.filter("role <> 'inner'")
    edges = polygon_edges(whole.select(F.struct("poly", "ring").alias("poly"), F.lit(0).alias("ring"), "pos", "x", "y"))
    # A hole's vertex may touch its ring, so the middle of its first edge decides.
    first = rings.filter("role = 'inner' AND pos < 2").groupBy("poly", "ring").agg(F.avg("x").alias("lon"), F.avg("y").alias("lat")).select(F.struct("poly", "ring").alias("hole"), "lat", "lon")
    inside = point_in_polygon(first, edges, "hole").filter("hole.poly = poly.poly").groupBy("hole").agg(F.min("poly.ring").alias("outer"))
    holes = rings.filter("role = 'inner'").join(inside.select(F.col("hole.poly").alias("poly"), F.col("hole.ring").alias("ring"), "outer"), ["poly", "ring"])
    columns = ["poly", "outer", "role", "ring", "pos", "x", "y"]
    return whole.withColumn("outer", F.col("ring")).select(*columns).unionByName(holes.select(*columns))


def features(rings: DataFrame) -> DataFrame:
    """(name, kind, ring, pos, x, y) as ``write_geojson`` takes them: a feature for each outer ring, which is its ring 0, holes after it."""
    order = F.when(F.col("ring") == F.col("outer"), F.lit(0)).otherwise(1)
    named = rings.select(F.col("poly").alias("name"), "outer", "ring", order.alias("_o")).distinct()
    number = F.array_position(F.array_sort(F.collect_list(F.struct("_o", "ring")).over(Window.partitionBy("name", "outer"))), F.struct("_o", "ring")) - 1
    named = named.withColumn("number", number.cast("int"))
    met = rings.withColumnRenamed("poly", "name").join(named.select("name", "outer", "ring", "number"), ["name", "outer", "ring"])
    return met.select("name", F.concat(F.lit("ring "), "outer").alias("kind"), F.col("number").alias("ring"), "pos", "x", "y")


def _sides(rings: DataFrame) -> DataFrame:
    """Each vertex with the next one of its ring (``_x``, ``_y``)."""
    after = rings.select(*KEYS, "ring", F.col("pos").alias("_p"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    size = rings.groupBy(*KEYS, "ring").agg(F.count(F.lit(1)).alias("n"))
    return rings.join(_spread(size), [*KEYS, "ring"]).withColumn("_p", (F.col("pos") + 1) % F.col("n")).join(_spread(after), [*KEYS, "ring", "_p"])


def ring_measures(rings: DataFrame) -> DataFrame:
    """(poly, role, ring, n, area, length): points, area by the shoelace formula and length, in the coordinates' units."""
    area = F.abs(F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y"))) / 2
    length = F.sum(F.sqrt((F.col("_x") - F.col("x")) * (F.col("_x") - F.col("x")) + (F.col("_y") - F.col("y")) * (F.col("_y") - F.col("y"))))
    return _sides(rings).groupBy(*KEYS, "ring").agg(F.count(F.lit(1)).alias("n"), area.alias("area"), length.alias("length"))


def ring_centroids(rings: DataFrame) -> DataFrame:
    """(poly, role, x, y): the centroid of each outline's largest ring; of rings without area the mean of the vertices."""
    # Taken from a vertex of the ring, as differences of large products lose digits.
    origin = rings.filter("pos = 0").select(*KEYS, "ring", F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    at = {c: F.col(c) - F.col(f"_o{c[-1]}") for c in ("x", "y", "_x", "_y")}
    side = _sides(rings).join(origin, [*KEYS, "ring"]).withColumns(at)
    cross = F.col("x") * F.col("_y") - F.col("_x") * F.col("y")
    sums = side.groupBy(*KEYS, "ring", "_ox", "_oy").agg(F.sum(cross).alias("a"), *[F.sum((F.col(c) + F.col(f"_{c}")) * cross).alias(f"m{c}") for c in ("x", "y")], *[F.avg(c).alias(f"mean_{c}") for c in ("x", "y")])
    middle = sums.withColumns({c: F.col(f"_o{c}") + F.coalesce(F.try_divide(F.col(f"m{c}"), F.nullif(3 * F.col("a"), F.lit(0.0))), F.col(f"mean_{c}")) for c in ("x", "y")})
    return middle.groupBy(*KEYS).agg(F.max_by(F.struct("x", "y"), F.struct(F.abs("a"), -F.col("ring"))).alias("c")).select(*KEYS, "c.x", "c.y")
