from datetime import datetime, timedelta

import numpy as np
from gridcast.plans import matrix, ml, training
from gridcast.sources import readers, rest, stores
from pyspark.sql import functions as F

T0 = datetime(2022, 1, 1)


def data(spark, days=700):
    rng = np.random.default_rng(1)
    x, z = rng.uniform(0, 1, days), rng.uniform(0, 1, days)
    rows = [(T0 + timedelta(days=i), float(x[i]), float(z[i]), float(0.8 * x[i] + 0.1 * z[i]), 100.0) for i in range(days)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, prior double, z double, wind_cf double, wind_cap_mw double")


def test_training_run_fills_the_stores(spark, tmp_path):
    store = str(tmp_path)
    for _ in range(2):  # a second run replaces its rows
        training.train(data(spark), {"linear": ml.linear()}, ["prior", "z"], ("wind",), store, n=2, test_days=200)
    m = stores.read_store(spark, f"{store}/cv_metrics")
    assert m.count() == m.dropDuplicates(["model", "technology", "fold", "scale"]).count() == 2 * 2 + 2 * 2
    best = {r["model"]: r["mae"] for r in m.filter("scale = 'cf'").groupBy("model").agg(F.avg("mae").alias("mae")).collect()}
    assert best["linear"] < 1e-6 < min(best["persistence"], best["climatology"])
    oof = stores.read_store(spark, f"{store}/oof")
    assert oof.count() == 400 and oof.filter("abs(pred_mw - y_mw) > 1e-4").count() == 0


def test_models_save_and_load(spark, tmp_path):
    df = data(spark, 100)
    p = ml.linear()(df, ["prior", "z"], "wind_cf")
    p.save(str(tmp_path / "m"))
    again = ml.Predictor.load(str(tmp_path / "m"))(df)
    assert again.join(p(df).select("ts", F.col("pred").alias("q")), "ts").filter("abs(pred - q) > 1e-12").count() == 0
    imp = {r["feature"]: r["importance"] for r in ml.permutation_importance(df, p, ["prior", "z"], "wind_cf").collect()}
    assert imp["prior"] > imp["z"] > 0


def test_municipal_matrix(spark):
    h = [T0 + timedelta(hours=i) for i in range(3)]
    assets = spark.createDataFrame([("r", "wind", 1, 1, 2000.0), ("r", "wind", 1, 1, 1000.0), ("r", "solar", 1, 2, 500.0), ("s", "wind", 1, 1, 100.0)], "region string, technology string, node_lat int, node_lon int, kw double")
    weather = spark.createDataFrame([(1, k, t, 0.5, 0.2, 10.0 * k) for k in (1, 2) for t in h], "node_lat int, node_lon int, ts timestamp_ntz, wind_pu double, solar_pu double, temperature_2m double")
    actual = spark.createDataFrame([("r", t + timedelta(minutes=m), 1.0 + m) for t in h for m in (0, 15)], "region string, ts timestamp_ntz, wind_kw double")
    got = matrix.municipal_matrix(assets, weather, actual).orderBy("ts").collect()
    assert len(got) == 3 and all(r["region"] == "r" for r in got)
    r = got[0]
    assert abs(r["wind_prior_mw"] - 1.5) < 1e-12 and abs(r["solar_prior_mw"] - 0.1) < 1e-12 and r["temperature_2m"] == 15.0
    assert abs(r["wind_prior_cf"] - 0.5) < 1e-12 and r["wind_kw"] == 8.5


def test_way_edges_and_digests(spark, tmp_path):
    square = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    ways = [square[:3], square[2:]]
    members = ",".join('{"type":"way","role":"outer","geometry":[' + ",".join(f'{{"lat":{a}.0,"lon":{b}.0}}' for a, b in w) + "]}" for w in ways)
    (tmp_path / "b.json").write_text('{"elements":[{"members":[' + members + ',{"type":"node","role":"x"}]}]}')
    from gridcast.operators.spatial import point_in_polygon

    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0)], "id int, lat double, lon double")
    edges = readers.read_way_edges(spark, str(tmp_path / "b.json"), "sq")
    assert [r["id"] for r in point_in_polygon(pts, edges, "id").collect()] == [1]
    assert readers.file_digests(spark, str(tmp_path / "b.json")).first()["sha256"].isalnum()


def hourly(url):
    start = url.split("start_date=")[1].split("&")[0]
    return {"hourly": {"time": [f"{start}T00:00", f"{start}T01:00", f"{start}T02:00"], "t": [7.0, None, 9.0]}}


def test_extension_upserts_what_is_new(spark, tmp_path):
    path = str(tmp_path / "w")
    stores.publish(spark.createDataFrame([(513, 110, datetime(2024, 1, 2), 1.0), (513, 110, datetime(2024, 1, 1), 2.0)], "node_lat int, node_lon int, ts timestamp_ntz, t double"), path, rest.NODE_KEYS)
    rest.extend_store(spark, path, {"variables": "t", "transport": "tests.test_plans:hourly"}, "2024-01-02")
    got = sorted((r["ts"], r["t"]) for r in stores.read_store(spark, path).collect())
    assert got == [(datetime(2024, 1, 1), 2.0), (datetime(2024, 1, 2), 7.0), (datetime(2024, 1, 2, 2), 9.0)]
