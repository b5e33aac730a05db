import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from gridcast.operators import physics, spatial
from gridcast.plans import calibrate, ml, run
from gridcast.plans.trees import Shape
from gridcast.sources import readers, stores, writers
from pyspark.sql import functions as F

T0 = datetime(2022, 1, 1)


def noisy(spark, n=1500):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, n)
    y = x + rng.normal(0, 0.05 + 0.2 * x, n)
    return spark.createDataFrame([(T0 + timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "ts timestamp_ntz, x double, y double")


def test_quantile_trees_cover_what_they_should(spark):
    df = noisy(spark)
    predict = ml.quantile_boosted(shape=Shape(trees=120, rate=0.1))(df, ["x"], "y")
    rows = predict(df).toPandas()
    assert ((rows.lo <= rows.pred) & (rows.pred <= rows.hi)).all()
    inside = ((rows.y >= rows.lo) & (rows.y <= rows.hi)).mean()
    assert 0.72 < inside < 0.9
    wide = rows.hi - rows.lo
    assert wide[rows.x > 0.8].mean() > 2 * wide[rows.x < 0.2].mean()  # bands follow the noise


def test_a_sequence_learner_uses_the_rows_before(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, 400)
    rows = [(T0 + timedelta(hours=i), float(x[i]), float(x[i - 2]) if i > 1 else 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double, y double")
    got = ml.sequence(ml.linear(), 4)(df, ["x"], "y")(df)
    assert set(got.columns) >= {"ts", "x", "y", "pred"} and got.count() == 397
    assert got.agg(F.max(F.abs(F.col("y") - F.col("pred")))).first()[0] < 1e-6
    plain = ml.linear()(df, ["x"], "y")(df)
    assert plain.agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0] > 0.1


def test_attribution_adds_up_for_a_linear_model(spark):
    df = noisy(spark, 200).withColumn("z", F.col("x") * F.col("x"))
    predict = ml.linear()(df, ["x", "z"], "y")
    rows = ml.attribution(df, predict, ["x", "z"]).toPandas()
    assert np.allclose(rows.by_x + rows.by_z + predict(df).toPandas().pred.mean(), rows.pred, atol=1e-6)


def test_conformal_bands_find_the_order_statistic(spark):
    """A large group with many ties beside a small one."""
    rng = np.random.default_rng(5)
    n = 6000
    rows = [("big", float(np.round(y, 2)), 0.0, float(h)) for y, h in zip(rng.normal(0, 1, n), rng.uniform(0.1, 1, n), strict=True)] + [("small", float(k), 0.0, 1.0 + k) for k in range(7)]
    df = spark.createDataFrame(rows, "g string, y double, lo double, hi double")
    got = {r["g"]: r for r in calibrate.fit_conformal(df, ["g"]).collect()}
    for g in ("big", "small"):
        own = [(y, lo, hi) for k, y, lo, hi in rows if k == g]
        y, lo, hi = map(np.array, zip(*own, strict=True))
        half, m = (hi - lo) / 2, len(y)
        at = int(np.ceil(min(np.ceil((m + 1) * 0.8) / m, 1) * (m - 1)))
        best = None
        for f in calibrate.FLOORS:
            w = np.maximum(half, f * half.mean())
            q = np.sort(np.maximum(lo - y, y - hi) / w)[at]
            width = np.mean(hi + q * w - np.maximum(lo - q * w, 0))
            if best is None or round(width, 6) < best[0]:
                best = (round(width, 6), q, f * half.mean())
        assert got[g]["n"] == m and np.allclose([got[g]["q"], got[g]["w_floor"]], best[1:], atol=1e-9)


def test_numbers_go_on_over_ranges(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(6).permutation(5000)], "k long").repartition(7)
    got = spatial.numbered(df, ["k"], "n").collect()
    assert all(r["k"] == r["n"] for r in got) and len(got) == 5000
    assert spatial.numbered(df.limit(0), ["k"], "n").count() == 0


def test_refraction_and_turbid_sky(spark):
    df = spark.createDataFrame([(0.0, datetime(2024, 6, 21, 12)), (60.0, datetime(2024, 6, 21, 12)), (90.0, datetime(2024, 6, 21, 12)), (100.0, datetime(2024, 6, 21, 12)), (None, datetime(2024, 6, 21, 12))], "z double, ts timestamp_ntz")
    rows = df.select("z", physics.refracted(F.col("z")).alias("a")).select("z", "a", physics.clear_sky_turbid(F.col("a"), F.lit("2024-06-21 12:00:00").cast("timestamp_ntz"), 3.0).alias("ghi")).collect()
    by = {r["z"]: r for r in rows}
    assert abs(by[60.0]["z"] - by[60.0]["a"] - 0.0283) < 0.002 and 0.4 < 90.0 - by[90.0]["a"] < 0.6  # known refractions
    assert 950 < by[0.0]["ghi"] < 1080 and 430 < by[60.0]["ghi"] < 520 and by[100.0]["ghi"] == 0 and by[None]["ghi"] is None


def test_geometry_gates_the_prior(spark):
    hours = [T0 + timedelta(hours=k) for k in range(4)]
    weather = spark.createDataFrame([(c, t, 500.0) for c in ("a", "b") for t in hours], "cluster_id string, ts timestamp_ntz, shortwave_radiation double")
    capacity = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "cluster_id string, capacity_mw double")
    geometry = weather.filter("hour(ts) < 2").select("cluster_id", "ts")
    assert physics.solar_prior(weather, capacity).count() == 4
    got = physics.solar_prior(weather, capacity, geometry).collect()
    assert len(got) == 2 and all(abs(r["prior_mw"] - 0.5 * 0.8 * 30) < 1e-9 for r in got)


def test_a_log_is_migrated_and_a_mapping_merged(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_rows(spark.createDataFrame([(1, 2.0)], "a int, b double"), path)
    writers.append_rows(spark.createDataFrame([(2, "x")], "a int, c string"), path, migrate=True)
    assert sorted(map(tuple, spark.read.parquet(path).select("a", "b", "c").collect())) == [(1, 2.0, None), (2, None, "x")]
    where = str(tmp_path / "map")
    assert readers.read_mapping(spark, where).count() == 0
    row = lambda k, v: spark.createDataFrame([(k, v)], "key string, values map<string, double>")
    writers.merge_mapping(row("a", {"scale": 1.23456789}), where)
    writers.merge_mapping(row("b", {"scale": 2.0}), where)
    writers.merge_mapping(row("b", {"offset": 3.0}), where)
    assert {r["key"]: r["values"] for r in readers.read_mapping(spark, where).collect()} == {"a": {"scale": 1.234568}, "b": {"offset": 3.0}}


def test_newest_by_name(spark, tmp_path):
    for stamp in ("20240101", "20240301", "20240201"):
        spark.createDataFrame([(stamp,)], "s string").write.parquet(str(tmp_path / f"run_{stamp}.parquet"))
    assert readers.read_newest(spark, str(tmp_path / "run_*")).first()["s"] == "20240301"
    with pytest.raises(FileNotFoundError):
        readers.read_newest(spark, str(tmp_path / "none_*"))


def test_forecast_mode(spark, tmp_path):
    hours = [T0 + timedelta(hours=k) for k in range(30)]
    features = spark.createDataFrame([(d, t, 0.5) for d in ("a", "b") for t in hours], "district string, ts timestamp_ntz, x double")
    predict = lambda df: df.withColumns({"lo": F.col("x") * 0.5, "pred": F.col("x"), "hi": F.col("x") * 1.5})
    calibration = spark.createDataFrame([("wind", 2.0, 0.0)], "technology string, scale double, offset double")
    fleets = spark.createDataFrame([(d, k, 10.0) for d in ("a", "b") for k in ("wind", "solar")], "district string, technology string, cap_mw double")
    now = F.lit("2022-01-01 02:30:00").cast("timestamp_ntz")
    how = {"features": features, "predictors": {"wind": predict, "solar": predict}, "calibration": calibration, "fleets": fleets, "now": now}
    run.run(spark, "forecast", str(tmp_path), **how)
    rows = stores.read_store(spark, str(tmp_path / "forecast")).collect()
    assert len(rows) == 48 and all((r["wind_median_mw"], r["solar_median_mw"], r["solar_lower_mw"]) == (10.0, 5.0, 2.5) for r in rows)
    state = stores.read_store(spark, str(tmp_path / "state")).collect()
    assert len(state) == 24 and all(r["wind_median_mw"] == 20.0 for r in state) and min(r["ts"] for r in state) == datetime(2022, 1, 1, 3)
    with pytest.raises(Exception, match="incomplete forecast"):
        run.run(spark, "forecast", str(tmp_path), **(how | {"features": features.filter("NOT (district = 'b' AND day(ts) = 2)")}))
    with pytest.raises(ValueError):
        run.run(spark, "other", str(tmp_path))


def test_trailing_quantiles_go_on_over_stretches(spark):
    from gridcast.operators import timeseries

    rng = np.random.default_rng(8)
    rows = [(k, T0 + timedelta(hours=6 * i), None if rng.random() < 0.1 else float(rng.normal())) for k in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double")
    got = {(r["k"], r["ts"]): r["q"] for r in timeseries.trailing_quantile(df, ["k"], "ts", "y", 10, 0.9, 5, "q").collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows[::7]:
        held = [y for k2, t2, y in rows if k2 == k and t - timedelta(days=10) < t2 <= t and y is not None]
        want = np.quantile(held, 0.9) if len(held) >= 5 else None
        assert got[(k, t)] is None if want is None else abs(got[(k, t)] - want) < 1e-9


def test_models_are_compared_in_pairs(spark):
    from gridcast.plans import significance

    rng = np.random.default_rng(9)
    y = rng.uniform(1, 2, 400)
    noise = {"a": 0.1, "b": 0.1, "c": 0.5}
    rows = [(m, T0 + timedelta(hours=i), float(y[i]), float(y[i] + rng.normal(0, s))) for m, s in noise.items() for i in range(400)]
    df = spark.createDataFrame([("wind", *r) for r in rows], "technology string, model string, ts timestamp_ntz, y double, pred double")
    got = {(r["model_a"], r["model_b"]): r for r in significance.compare_models(df, ["technology"], block=24, reps=200).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and all(r["n_hours"] == 400 for r in got.values())
    assert got[("a", "c")]["gap_hi"] < 0 and got[("a", "c")]["dm"] < -5 and got[("a", "c")]["dm_p"] < 1e-6
    assert got[("a", "b")]["gap_lo"] < 0 < got[("a", "b")]["gap_hi"] and got[("a", "b")]["dm_p"] > 0.01
    err = {m: np.array([p - t for k, _, t, p in rows if k == m]) for m in noise}
    assert abs(got[("a", "c")]["gap"] - (np.abs(err["a"]).sum() - np.abs(err["c"]).sum()) / y.sum()) < 1e-9


def test_pairs_of_features_explain_what_single_ones_cannot(spark):
    rng = np.random.default_rng(10)
    rows = [(float(a), float(b), float(c), float((a > 0.5) != (b > 0.5))) for a, b, c in rng.uniform(0, 1, (1200, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    error = lambda m: m(df).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    plain, paired = ml.additive(4)(df, ["a", "b", "c"], "y"), ml.additive(4, pairs=1)(df, ["a", "b", "c"], "y")
    assert error(plain) > 0.4 and error(paired) < 0.2
    imp = {r["feature"]: r["importance"] for r in paired.importance(df).collect()}
    assert max(imp, key=imp.get) == "a x b" and set(imp) == {"a", "b", "c", "a x b"}
    assert set(paired(df).columns) == {"a", "b", "c", "y", "pred"}


def test_conformal_bands_write_rows_that_agree_once(spark, monkeypatch):
    from gridcast.plans import checkpoint

    written, cut = [], checkpoint.cut
    monkeypatch.setattr(checkpoint, "cut", lambda df: written.append(cut(df)) or written[-1])
    one = spark.range(90).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 31).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("lo"), (F.col("id") % 5 + F.col("id") % 9).cast("double").alias("hi"))
    many = one.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("_")
    got = {r["g"]: r for r in calibrate.fit_conformal(many, ["g"]).collect()}
    assert max(df.count() for df in written) <= 2 * 13 * 90
    for g, r in got.items():
        rows = [(x["y"], x["lo"], x["hi"]) for x in one.filter(F.col("g") == g).collect()]
        mean, best = sum((hi - lo) / 2 for _, lo, hi in rows) / len(rows), None
        for f in calibrate.FLOORS:
            w = [max((hi - lo) / 2, f * mean) for _, lo, hi in rows]
            e = sorted([max(lo - y, y - hi) / x for (y, lo, hi), x in zip(rows, w, strict=True)] * 400)
            n = len(e)
            q = e[math.ceil(min(math.ceil((n + 1) * 0.8) / n, 1) * (n - 1))]
            width = sum(hi + q * x - max(lo - q * x, 0) for (_, lo, hi), x in zip(rows, w, strict=True)) / len(rows)
            best = min(best or (math.inf,), (round(width, 6), f, q), key=lambda b: b[0])
        assert r["n"] == 45 * 400 and math.isclose(r["q"], best[2]) and math.isclose(r["w_floor"], best[1] * mean) and math.isclose(r["width"], best[0], abs_tol=2e-6)
