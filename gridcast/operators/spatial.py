"""Snapping, radius and polygon joins, grid and density clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import EARTH_KM, EARTH_KM_CLUSTER, haversine, snap

KM_PER_DEGREE = 111.0  # a little under the true length, so that cells are never too small


def with_node(df: DataFrame, lat: str = "lat", lon: str = "lon", grid: float = 0.1) -> DataFrame:
    """Adds the weather node of each row as integers (``node_lat``, ``node_lon``)."""
    return df.withColumns({"node_lat": snap(lat, grid), "node_lon": snap(lon, grid)})


def radius_join(points: DataFrame, sites: DataFrame, radius_km: float, radius: float = EARTH_KM) -> DataFrame:
    """Pairs within the radius (inclusive), with ``km``; points: lat, lon; sites: site, site_lat, site_lon.

    Sites are spread over the latitude bands they reach, so that the join is an equi-join on bands; the distance filters the rest.
    """
    band = radius_km / KM_PER_DEGREE
    spread = sites.withColumn("_band", F.explode(F.sequence(F.floor((F.col("site_lat") - band) / band), F.floor((F.col("site_lat") + band) / band))))
    km = haversine("lat", "lon", "site_lat", "site_lon", radius)
    return points.withColumn("_band", F.floor(F.col("lat") / band)).join(spread, "_band").withColumn("km", km).filter(F.col("km") <= radius_km).drop("_band")


def radius_totals(points: DataFrame, sites: DataFrame, radius_km: float, keys: list[str], inner: dict, outer: dict, radius: float = EARTH_KM) -> DataFrame:
    """Totals by site and ``keys`` over the points within the radius (inclusive), without a row for each pair.

    Points that share a place and ``keys`` are one row of ``inner`` aggregates, sites that share a place are one; the distances are those between places.
    ``outer`` makes aggregates of aggregates, of ``inner`` and ``km``, twice: over the places that a site's place reaches, and over a site's rows.
    """
    spots = points.groupBy("lat", "lon", *keys).agg(*[c.alias(n) for n, c in inner.items()])
    near = radius_join(spots, sites.select("site_lat", "site_lon").distinct(), radius_km, radius)
    reached = near.groupBy("site_lat", "site_lon", *keys).agg(*[of(n if n in inner else "km").alias(n) for n, of in outer.items()])
    met = sites.select("site", "site_lat", "site_lon").join(reached, ["site_lat", "site_lon"])
    return met.groupBy("site", *keys).agg(*[of(n).alias(n) for n, of in outer.items()])


def polygon_edges(rings: DataFrame) -> DataFrame:
    """(poly, x1, y1, x2, y2) from ring vertices (poly, ring, pos, x, y); horizontal edges never count and are left out."""
    w = Window.partitionBy("poly", "ring").orderBy("pos")
    first = Window.partitionBy("poly", "ring").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in ("x", "y")}
    return rings.select("poly", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt["x"].alias("x2"), nxt["y"].alias("y2")).filter("y1 <> y2")


def point_in_polygon(points: DataFrame, edges: DataFrame, key: str, x: str = "lon", y: str = "lat", cells: float = 10.0) -> DataFrame:
    """(key, poly) for points strictly inside by even-odd crossing; holes and several rings are more edges.

    Edges are spread over the horizontal stripes they cross, so points meet only the edges of their own stripe.
    """
    stripe = lambda c: F.floor(F.col(c) * cells)
    spread = edges.withColumn("_s", F.explode(F.sequence(F.least(stripe("y1"), stripe("y2")), F.greatest(stripe("y1"), stripe("y2")))))
    hit = ((F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))) & (F.col(x) < F.try_divide((F.col("x2") - F.col("x1")) * (F.col(y) - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1"))
    return points.withColumn("_s", stripe(y)).join(spread, "_s").filter(hit).groupBy(key, "poly").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1").drop("_n")


def weighted_centroids(df: DataFrame, keys: list[str], weight: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Sum, count and weighted centroid by key; the plain mean where the weights sum to zero."""
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col(weight)), F.nullif(F.sum(weight), F.lit(0.0))), F.avg(c))
    return df.groupBy(*keys).agg((F.sum(weight) / 1000.0).alias("capacity_mw"), F.count(F.lit(1)).alias("assets"), mean(lat).alias("centroid_lat"), mean(lon).alias("centroid_lon"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in an order of distinct values: sorted in ranges, numbered within each, and moved on by the ranges before it."""
    from ..plans.checkpoint import cut

    placed = cut(df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(F.broadcast(start.drop("_n")), "_range").withColumn(name, F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")


def batches(df: DataFrame, order: list[str], size: int, name: str = "batch") -> DataFrame:
    """Numbers of batches of ``size`` rows in an order."""
    return numbered(df, order, name).withColumn(name, F.floor(F.col(name) / size))


def grid_clusters(df: DataFrame, weight: str, grid: float = 0.1, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Clusters by grid cell, numbered from 0 by latitude and longitude (over cells, not rows)."""
    cells = weighted_centroids(df.withColumns({"cell_lat": snap(lat, grid), "cell_lon": snap(lon, grid)}), ["cell_lat", "cell_lon"], weight, lat, lon)
    return numbered(cells, ["cell_lat", "cell_lon"], "cluster")


def near_pairs(points: DataFrame, key: str, radius_km: float, radius: float = EARTH_KM_CLUSTER) -> DataFrame:
    """(a, b) with a < b for points within the radius: cells of at least the radius, each met with its neighbours.

    Points that share a place are collapsed to the smallest key first, so a crowded place costs one row; they get a pair with it.
    """
    d = radius_km / KM_PER_DEGREE
    spots = points.groupBy("lat", "lon").agg(F.min(key).alias("_k"))
    same = points.join(spots, ["lat", "lon"]).filter(F.col(key) != F.col("_k")).select(F.col("_k").alias("a"), F.col(key).alias("b"))
    # Longitude cells of a latitude band are as wide as the radius at the band's far edge.
    row = F.floor(F.col("lat") / d)
    placed = spots.select("lat", "lon", "_k", row.alias("_r"))

    def at(c):
        far = F.least(F.abs(F.col("_r") * d), F.lit(89.0)) + F.lit(2 * d)
        return F.floor(c * F.cos(F.radians(far)) / d)

    mine = placed.withColumn("_c", at(F.col("lon")))
    # In each band a point reaches the cells within the radius to both sides.
    reach = placed.withColumn("_r", F.explode(F.sequence(F.col("_r") - 1, F.col("_r") + 1)))
    reach = reach.withColumn("_c", F.explode(F.sequence(at(F.col("lon")) - 1, at(F.col("lon")) + 1)))
    pairs = mine.alias("p").join(reach.alias("q"), ["_r", "_c"]).filter(F.col("p._k") < F.col("q._k"))
    close = pairs.filter(haversine("p.lat", "p.lon", "q.lat", "q.lon", radius) <= radius_km).select(F.col("p._k").alias("a"), F.col("q._k").alias("b"))
    return close.union(same)


def _span(lo_a, hi_a, lo_b, hi_b):
    """(smallest, largest) difference between two intervals' values."""
    return F.greatest(F.lit(0.0), F.col(lo_b) - F.col(hi_a), F.col(lo_a) - F.col(hi_b)), F.greatest(hi_a, hi_b) - F.least(lo_a, lo_b)


def _sin2(degrees) -> F.Column:
    half = F.sin(F.radians(degrees) / 2)
    return half * half


def any_within(a: np.ndarray, b: np.ndarray, limit: float, small: int = 64) -> bool:
    """Whether any of the points ``a`` (radians: latitude, longitude) has a haversine of at most ``limit`` to any of ``b``.

    Boxes of points are halved until they are surely near (the search ends), surely far, or small enough to compare.
    """
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        (lo_a, hi_a), (lo_b, hi_b) = (a.min(0), a.max(0)), (b.min(0), b.max(0))
        gap, reach = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b)), np.maximum(hi_a, hi_b) - np.minimum(lo_a, lo_b)
        low, high = min(lo_a[0], lo_b[0]), max(hi_a[0], hi_b[0])
        wide, narrow = 1.0 if low <= 0 <= high else max(math.cos(low), math.cos(high)), min(math.cos(low), math.cos(high))
        least = math.sin(gap[0] / 2) ** 2 + narrow**2 * math.sin(min(gap[1], math.pi) / 2) ** 2
        if least > limit * (1 + 1e-9):
            continue
        if reach[1] < math.pi and math.sin(reach[0] / 2) ** 2 + wide**2 * math.sin(reach[1] / 2) ** 2 < limit * (1 - 1e-9):
            return True
        if len(a) <= small and len(b) <= small:
            h = np.sin((a[:, None, 0] - b[None, :, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((a[:, None, 1] - b[None, :, 1]) / 2) ** 2
            if (h <= limit).any():
                return True
            continue
        first = len(a) >= len(b)
        part, other = (a, b) if first else (b, a)
        axis = int(np.argmax(part.max(0) - part.min(0)))
        part = part[np.argpartition(part[:, axis], len(part) // 2)]
        todo += [(half, other) if first else (other, half) for half in (part[: len(part) // 2], part[len(part) // 2 :])]
    return False


def cell_edges(points: DataFrame, key: str, radius_km: float, radius: float = EARTH_KM_CLUSTER, block: int = 20_000) -> DataFrame:
    """(a, b) edges with the components of all pairs within the radius, at most about one a point and one for each pair of neighbouring cells.

    Cells have a diagonal of the radius: their points are all near each other and hang on the smallest key. Two cells need one edge, if any two of their
    points are near; most pairs of cells are decided by the boxes of their points, the others by a search that ends at the first near pair. Cells of over
    ``block`` places are dealt as pairs of blocks. Longitudes don't wrap around.
    """
    from ..plans.checkpoint import cut

    limit, h = math.sin(radius_km / 2 / radius) ** 2, radius_km / math.sqrt(2) / math.radians(radius) * (1 - 1e-9)
    spots = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(F.min(key).alias("_k"))
    same = points.join(spots, ["lat", "lon"]).filter(F.col(key) != F.col("_k")).select(F.col("_k").alias("a"), F.col(key).alias("b"))
    # A band's cells are as wide as they are high where it is widest.
    inner = lambda r: F.when(r >= 0, r * h).otherwise(-(r + 1) * h)
    outer = lambda r: F.least(F.lit(89.9), F.when(r >= 0, (r + 1) * h).otherwise(-r * h))
    width = lambda r: F.lit(h) / F.cos(F.radians(F.least(F.lit(89.9), inner(r))))
    band = F.floor(F.col("lat") / h)
    placed = cut(spots.withColumn("_r", band).withColumn("_c", F.floor(F.col("lon") / width(F.col("_r")))))
    box = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    cells = cut(placed.groupBy("_r", "_c").agg(*box, F.min("_k").alias("rep"), F.count(F.lit(1)).alias("n")))
    inside = placed.join(cells.select("_r", "_c", "rep"), ["_r", "_c"]).filter("_k <> rep").select(F.col("rep").alias("a"), F.col("_k").alias("b"))
    # Longitudes further apart than this are further than the radius, in both bands.
    reach = cells.withColumn("_r2", F.explode(F.sequence(F.col("_r"), F.col("_r") + 2)))
    far = F.cos(F.radians(F.greatest(outer(F.col("_r")), outer(F.col("_r2")))))
    reach = reach.withColumn("_d", F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(math.sqrt(limit)) / far))) * (1 + 1e-9))
    at = lambda c: F.floor(c / width(F.col("_r2")))
    reach = reach.withColumn("_c2", F.explode(F.sequence(at(F.col("lo_lon") - F.col("_d")), at(F.col("hi_lon") + F.col("_d"))))).filter("_r2 > _r OR _c2 > _c")
    other = cells.select(*[F.col(c).alias(f"{c}2" if c.startswith("_") else f"o_{c}") for c in cells.columns])
    pairs = reach.join(other, ["_r2", "_c2"])
    (near_lat, far_lat), (near_lon, far_lon) = (_span(f"lo_{c}", f"hi_{c}", f"o_lo_{c}", f"o_hi_{c}") for c in ("lat", "lon"))
    low, high = F.least("lo_lat", "o_lo_lat"), F.greatest("hi_lat", "o_hi_lat")
    ends = F.cos(F.radians(low)), F.cos(F.radians(high))
    wide, narrow = F.when((low <= 0) & (high >= 0), F.lit(1.0)).otherwise(F.greatest(*ends)), F.least(*ends)
    sure = _sin2(far_lat) + wide * wide * _sin2(far_lon) < limit * (1 - 1e-9)
    never = _sin2(near_lat) + narrow * narrow * _sin2(near_lon) > limit * (1 + 1e-9)
    decided = cut(pairs.withColumns({"sure": sure, "never": never}).filter("NOT never").select("_r", "_c", "_r2", "_c2", "rep", "o_rep", "n", "o_n", "sure"))
    blocks = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block) - 1)
    open_ = decided.filter("NOT sure").withColumn("_b", F.explode(blocks("n"))).withColumn("_b2", F.explode(blocks("o_n")))
    mine = lambda n: F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col(n) / block))
    first = placed.join(open_, ["_r", "_c"]).filter(mine("n") == F.col("_b"))
    second = placed.withColumnsRenamed({"_r": "_r2", "_c": "_c2"}).join(open_, ["_r2", "_c2"]).filter(mine("o_n") == F.col("_b2"))
    both = first.select("rep", "o_rep", "_b", "_b2", F.lit(0).alias("side"), "lat", "lon").unionByName(second.select("rep", "o_rep", "_b", "_b2", F.lit(1).alias("side"), "lat", "lon"))
    keys = dict(points.dtypes)[key]

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        at, side = np.radians(frame[["lat", "lon"]].to_numpy(float)), frame["side"].to_numpy()
        near = (side == 0).any() and (side == 1).any() and any_within(at[side == 0], at[side == 1], limit)
        return pd.DataFrame({"a": frame["rep"].iloc[:1], "b": frame["o_rep"].iloc[:1]}) if near else pd.DataFrame({"a": frame["rep"].iloc[:0], "b": frame["o_rep"].iloc[:0]})

    found = both.groupBy("rep", "o_rep", "_b", "_b2").applyInPandas(search, f"a {keys}, b {keys}").distinct()
    return same.unionByName(inside).unionByName(decided.filter("sure").select(F.col("rep").alias("a"), F.col("o_rep").alias("b"))).unionByName(found)


def connected(edges: DataFrame, nodes: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """(key, component) with the smallest key reachable; edges: a, b. Minimum labels with pointer jumping, checkpointed every round."""
    from ..plans.checkpoint import cut

    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select(F.col(key).alias("a"), F.col(key).alias("l")))
    last = None
    for _ in range(rounds):
        low = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(low, "a", "left").select("a", F.least("l", F.coalesce("m", "l")).alias("l"))
        label = cut(step.join(step.select(F.col("a").alias("l"), F.col("l").alias("ll")), "l").select("a", F.col("ll").alias("l")))
        now = label.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == last:
            return label.select(F.col("a").alias(key), F.col("l").alias("component"))
        last = now
    raise RuntimeError("components did not settle")


def density_clusters(points: DataFrame, key: str, radius_km: float) -> DataFrame:
    """Density clusters with a minimum of one point: components of the radius graph, numbered from 0 by their smallest key."""
    comp = connected(cell_edges(points, key, radius_km), points, key)
    number = numbered(comp.select("component").distinct(), ["component"], "cluster")
    return comp.join(number, "component").select(key, "cluster")
