"""Registries that live in the configuration: districts with their kinds, and municipalities with their places; and the districts' outlines.

A registry is some dozen rows, read on the driver and handed to Spark as a table. Outlines are fetched once by a transport that is a parameter, at the pace that the
service asks for, and kept as one GeoJSON file that ``read_geojson`` reads.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_geojson

LOG = logging.getLogger("gridcast")
PAUSE = 1.1  # seconds between requests; the service allows one a second


def districts(spark: SparkSession, config: dict, kinds: dict[str, tuple[str, str]], section: str = "districts") -> DataFrame:
    """(ord, name, kind, query) of the names that the section lists; ``kinds``: kind -> (key of the list, query with ``{name}``).

    Order is that of the kinds, then of the lists. A missing section or list raises, as does a name that occurs twice.
    """
    rows = []
    for kind, (key, query) in kinds.items():
        rows += [(len(rows) + i, name, kind, query.format(name=name)) for i, name in enumerate(config[section][key])]
    if len({r[1] for r in rows}) < len(rows):
        raise ValueError("a district is listed twice")
    return spark.createDataFrame(rows, "ord int, name string, kind string, query string")


def municipalities(spark: SparkSession, config: dict, path: tuple[str, ...] = ("scraper", "regions"), results: str = "results/{slug}") -> DataFrame:
    """(slug, lat, lon, telemetry, results_dir) of the configured regions that have a place; others are named in the log and left out."""
    found = config
    for key in path:
        found = found[key]
    placed = {slug: r for slug, r in found.items() if r.get("lat") is not None and r.get("lon") is not None}
    for slug in found.keys() - placed.keys():
        LOG.warning("region %s has no place", slug)
    rows = [(slug, float(r["lat"]), float(r["lon"]), r.get("csv_path"), r.get("results_dir") or results.format(slug=slug)) for slug, r in placed.items()]
    return spark.createDataFrame(rows, "slug string, lat double, lon double, telemetry string, results_dir string")


def fetch_districts(get: Callable[[str], list], url: str, registry: DataFrame, path: str, force: bool = False, country: str = "de", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The outlines of all districts of a registry (as ``read_geojson`` has them), fetched by ``get`` where ``path`` has none yet or with ``force``.

    A district without a reply raises, and no file is written: what is kept is complete.
    """
    spark, file = registry.sparkSession, Path(path)
    if force or not file.exists():
        features = []
        for r in registry.orderBy("ord").collect():
            reply = get(f"{url}?{urlencode({'q': r['query'], 'format': 'jsonv2', 'polygon_geojson': 1, 'limit': 1, 'countrycodes': country})}")
            if not reply:
                raise RuntimeError(f"no outline of {r['query']}")
            features.append({"type": "Feature", "properties": {"name": r["name"], "kind": r["kind"]}, "geometry": reply[0]["geojson"]})
            sleep(PAUSE)
        file.parent.mkdir(parents=True, exist_ok=True)
        staged = file.with_name(f"{file.name}.new")
        staged.write_text(json.dumps({"type": "FeatureCollection", "features": features}), encoding="utf-8")
        staged.replace(file)
    return complete(read_geojson(spark, path), registry)


def complete(rings: DataFrame, registry: DataFrame) -> DataFrame:
    """The outlines, if every district of the registry has one; else an error that names those without."""
    missing = sorted(r["name"] for r in registry.join(rings, "name", "left_anti").select("name").collect())
    if missing:
        raise ValueError(f"no outline of {', '.join(missing)}")
    return rings


def centroids(rings: DataFrame) -> DataFrame:
    """(name, lon, lat): the centroid of each outline by its largest ring."""
    from ..operators.outlines import ring_centroids

    return ring_centroids(rings.select(F.col("name").alias("poly"), F.lit("outer").alias("role"), "ring", "pos", "x", "y")).select(F.col("poly").alias("name"), F.col("x").alias("lon"), F.col("y").alias("lat"))
