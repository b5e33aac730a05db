import json
import math

import pytest
from gridcast.operators import outlines
from gridcast.sources import registries as R

CONFIG = {
    "districts": {"rural": ["Alpha", "Beta"], "towns": ["Gamma"]},
    "scraper": {"regions": {"a": {"lat": "52.3", "lon": 13.6, "csv_path": "a.csv"}, "b": {"csv_path": "b.csv"}, "c": {"lat": 51, "lon": 11, "csv_path": "c.csv", "results_dir": "elsewhere"}}},
}
KINDS = {"rural": ("rural", "District {name}"), "town": ("towns", "{name}, Land")}


def test_districts_and_municipalities(spark):
    got = [tuple(r) for r in R.districts(spark, CONFIG, KINDS).orderBy("ord").collect()]
    assert got == [(0, "Alpha", "rural", "District Alpha"), (1, "Beta", "rural", "District Beta"), (2, "Gamma", "town", "Gamma, Land")]
    rows = sorted(map(tuple, R.municipalities(spark, CONFIG).collect()))
    assert rows == [("a", 52.3, 13.6, "a.csv", "results/a"), ("c", 51.0, 11.0, "c.csv", "elsewhere")]
    with pytest.raises(KeyError):
        R.districts(spark, {}, KINDS)
    with pytest.raises(ValueError, match="twice"):
        R.districts(spark, {"districts": {"rural": ["X"], "towns": ["X"]}}, KINDS)


def test_outlines_are_fetched_once_and_whole(spark, tmp_path):
    asked, slept = [], []
    square = lambda x: {"type": "Polygon", "coordinates": [[[x, 0.0], [x + 2, 0.0], [x + 2, 2.0], [x, 2.0], [x, 0.0]]]}

    def get(url):
        asked.append(url)
        return [] if "Gamma" in url and len(asked) < 4 else [{"geojson": square(10.0 * len(asked))}]

    registry, path = R.districts(spark, CONFIG, KINDS), str(tmp_path / "d" / "districts.json")
    with pytest.raises(RuntimeError, match="Gamma"):
        R.fetch_districts(get, "http://n", registry, path, sleep=slept.append)
    assert not list(tmp_path.glob("d/*"))
    for _ in range(2):
        rings = R.fetch_districts(get, "http://n", registry, path, sleep=slept.append)
    assert len(asked) == 6 and slept == [1.1] * 5 and "q=District+Alpha" in asked[0]
    assert {r["name"]: r["kind"] for r in rings.collect()} == {"Alpha": "rural", "Beta": "rural", "Gamma": "town"}
    assert {r["name"]: (r["lon"], r["lat"]) for r in R.centroids(rings).collect()} == {"Alpha": (41.0, 1.0), "Beta": (51.0, 1.0), "Gamma": (61.0, 1.0)}
    held = json.loads((tmp_path / "d" / "districts.json").read_text())
    held["features"].pop()
    (tmp_path / "d" / "districts.json").write_text(json.dumps(held))
    with pytest.raises(ValueError, match="Gamma"):
        R.fetch_districts(get, "http://n", registry, path)


def test_centroid_of_the_largest_ring(spark):
    shape = [("p", "outer", 1, k, 5 + math.cos(k), 7 + math.sin(k)) for k in range(6)] + [("p", "outer", 2, k, x, y) for k, (x, y) in enumerate([(1e6, 0.0), (1e6 + 3, 0.0), (1e6, 3.0)])] + [("q", "outer", 1, 0, 1.0, 1.0), ("q", "outer", 1, 1, 3.0, 1.0)]
    got = {r["poly"]: (r["x"], r["y"]) for r in outlines.ring_centroids(spark.createDataFrame(shape, "poly string, role string, ring long, pos int, x double, y double")).collect()}
    assert got["p"] == pytest.approx((1e6 + 1, 1.0)) and got["q"] == (2.0, 1.0)
