import json
import math
import random

import numpy as np
import pytest
from gridcast.operators import outlines as O
from gridcast.operators.spatial import point_in_polygon, polygon_edges
from gridcast.sources import readers, writers
from pyspark.sql import functions as F

SCHEMA = "poly string, role string, way long, pos int, x double, y double"


def circle(x, y, r, n):
    return [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]


def cut_up(rng, poly, role, ring, first, most=4):
    """Way rows of a ring, cut at random corners, in any order and direction; numbers from ``first``."""
    at, parts = 0, []
    closed = [*ring, ring[0]]
    while at < len(ring):
        step = min(rng.randint(1, most), len(ring) - at)
        parts.append(closed[at : at + step + 1])
        at += step
    rng.shuffle(parts)
    out = []
    for i, part in enumerate(parts):
        part = part[::-1] if rng.random() < 0.5 else part
        out += [(poly, role, first + i, 10 * k, *p) for k, p in enumerate(part)]
    return out


def turned(ring):
    """A ring told from its smallest corner, in the direction of its smaller neighbour."""
    k = ring.index(min(ring))
    one = ring[k:] + ring[:k]
    two = one[:1] + one[:0:-1]
    return min(one, two)


def test_shuffled_reversed_ways_make_rings(spark):
    rng = random.Random(1)
    rings = {("a", "outer"): [circle(0, 0, 3, 37), circle(10, 0, 2, 3)], ("a", "inner"): [circle(0, 0, 1, 8), circle(10, 0, 0.5, 5), circle(50, 50, 1, 6)], ("b", "outer"): [circle(0, 0, 3, 37)]}
    rows = []
    for (poly, role), own in rings.items():
        for k, ring in enumerate(own):
            rows += cut_up(rng, poly, role, ring, 100 * k + 1)
    rows += [("b", "outer", 900, 0, 70.0, 70.0), ("b", "outer", 901, 0, 80.0, 80.0), ("b", "outer", 901, 1, 81.0, 80.0), ("b", "outer", 902, 0, 81.0, 80.0), ("b", "outer", 902, 1, 82.0, 81.0)]  # a point, and a chain that closes nothing
    rows += [("c", "outer", 5, k, *p) for k, p in enumerate([*circle(0, 0, 1, 4), circle(0, 0, 1, 4)[0]])]  # one closed way
    rng.shuffle(rows)
    got = {}
    found = O.assemble(spark.createDataFrame(rows, SCHEMA))
    for r in found.orderBy("poly", "role", "ring", "pos").collect():
        own = got.setdefault((r["poly"], r["role"]), {}).setdefault(r["ring"], [])
        assert r["pos"] == len(own)
        own.append((r["x"], r["y"]))
    want = rings | {("c", "outer"): [circle(0, 0, 1, 4)]}
    assert set(got) == set(want)
    for key, own in want.items():
        assert sorted(map(turned, got[key].values())) == sorted(map(turned, own))
    held = O.with_holes(found)
    outer = {r["ring"]: r["outer"] for r in held.filter("role = 'inner'").select("ring", "outer").distinct().collect()}
    assert len(outer) == 2 and len(set(outer.values())) == 2  # the third lies in no ring


def test_rings_answer_as_raw_edges_do(spark, tmp_path):
    rng = random.Random(2)
    rows = cut_up(rng, "p", "outer", circle(11, 52, 2, 41), 1) + cut_up(rng, "p", "inner", circle(11.2, 52.1, 0.7, 23), 1)
    ways = spark.createDataFrame(rows, SCHEMA)
    members = {}
    for _, role, way, pos, x, y in rows:
        members.setdefault((role, way), {})[pos] = {"lat": y, "lon": x}
    (tmp_path / "w.json").write_text(json.dumps({"elements": [{"members": [{"type": "way", "role": role, "geometry": [p[k] for k in sorted(p)]} for (role, _), p in members.items()]}]}))
    read = readers.read_ways(spark, str(tmp_path / "w.json"), "p")
    assert read.count() == ways.count()
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(np.random.default_rng(3).uniform([8.5, 49.5], [13.5, 54.5], (400, 2)))], "id int, lon double, lat double")
    raw = {r["id"] for r in point_in_polygon(points, readers.read_way_edges(spark, str(tmp_path / "w.json"), "p"), "id").collect()}
    shapes = O.features(O.with_holes(O.assemble(read)))
    writers.write_geojson(shapes, str(tmp_path / "g"))
    back = readers.read_geojson(spark, str(tmp_path / "g"))
    assert back.select("ring").distinct().count() == 2
    edges = polygon_edges(back)
    assert {r["id"] for r in point_in_polygon(points, edges, "id").collect()} == raw and 50 < len(raw) < 300
    assert {r["id"] for r in points.collect() if 0.7 < math.dist((r["lon"], r["lat"]), (11.2, 52.1)) and math.dist((r["lon"], r["lat"]), (11, 52)) < 1.9} <= raw
    size = {r["role"]: r["area"] for r in O.ring_measures(O.assemble(ways)).collect()}
    assert abs(size["outer"] - 41 / 2 * 4 * math.sin(2 * math.pi / 41)) < 1e-9


def test_a_meeting_of_three_ways_raises(spark):
    rows = [("p", "outer", w, k, *p) for w, line in enumerate([[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (0.0, 1.0)], [(1.0, 0.0), (2.0, 2.0)]]) for k, p in enumerate(line)]
    with pytest.raises(Exception, match="more than two ways"):
        O.assemble(spark.createDataFrame(rows, SCHEMA)).collect()
    assert O.assemble(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boundaries_are_fetched_once(spark, tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        return {"elements": [] if "relation(9)" in url or "relation%289%29" in url else [{"members": []}]}

    for _ in range(2):
        files = readers.fetch_boundaries(get, "http://x", {"a": 1, "b c": 2}, str(tmp_path / "b"))
    assert len(asked) == 2 and sorted(files) == ["a", "b c"] and readers.read_ways(spark, files["a"], "a").count() == 0
    with pytest.raises(ValueError, match="no outline"):
        readers.fetch_boundaries(get, "http://x", {"z": 9}, str(tmp_path / "b"))
    assert not list((tmp_path / "b").glob("z*")) and not list((tmp_path / "b").glob("*.new"))


def many_squares(spark, n):
    """Four ways of one side for each of ``n`` outlines."""
    at = spark.range(n).select(F.col("id").cast("string").alias("poly"), F.lit("outer").alias("role"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    side = at.withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("c", (F.col("k") + F.col("pos")) % 4)
    return side.select("poly", "role", F.col("k").cast("long").alias("way"), "pos", (F.col("c") / 2).cast("int").cast("double").alias("x"), F.col("c").isin(1, 2).cast("double").alias("y"))


def test_rounds_grow_with_an_outline_not_with_their_number(spark, monkeypatch):
    rounds, jump = [], O._jump
    monkeypatch.setattr(O, "_jump", lambda now, columns, more: rounds.append(more) or jump(now, columns, more))
    got = O.ring_measures(O.assemble(many_squares(spark, 300)))
    assert [tuple(r) for r in got.select("n", "area", "length").distinct().collect()] == [(4, 1.0, 4.0)] and got.count() == 300
    assert rounds[0] == "nxt IS NOT NULL AND steps <= 8"


def test_no_side_of_outlines_is_broadcast(spark):
    """A broadcast passes through the driver, which outlines of a whole country fill."""
    plan = O.ring_measures(O.assemble(many_squares(spark, 50)))
    plan.collect()
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
