from datetime import datetime, timedelta

import numpy as np
import pytest
from gridcast import schemas
from gridcast.functions import clip, finite, hour_ceil, is_finite
from gridcast.operators import clean, physics, spatial, timeseries
from gridcast.plans import calibrate, folds, forecast, metrics, ml, significance
from pyspark.sql import functions as F
from pyspark.sql import types as T

T0 = datetime(2024, 1, 1)


def series(spark, values, step=timedelta(hours=1)):
    return spark.createDataFrame([("a", T0 + i * step, v) for i, v in enumerate(values)], "k string, ts timestamp_ntz, y double")


def test_clip_and_finite_keep_nulls(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (float("nan"),), (float("inf"),), (2.0,)], "x double")
    got = df.select(clip("x", 0.0, 1.5).alias("c"), finite("x").alias("f"), is_finite("x").alias("i")).collect()
    assert [r["f"] for r in got] == [None, -1.0, None, None, 2.0] and [r["i"] for r in got] == [False, True, False, False, True]
    assert got[0]["c"] is None and got[1]["c"] == 0.0 and got[4]["c"] == 1.5


def test_gap_interpolation_limits(spark):
    v = [None, 1.0, None, None, None, 5.0, None, None, None, None, 10.0, None]
    got = [r["y"] for r in timeseries.interpolate_gaps(series(spark, v), ["k"], "ts", "y", 3).orderBy("ts").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 5.0, None, None, None, None, 10.0, None]
    assert timeseries.interpolate_gaps(series(spark, [None, None]), ["k"], "ts", "y").filter("y IS NOT NULL").count() == 0


def test_effective_capacity_never_looks_ahead(spark):
    rng = np.random.default_rng(1)
    y = rng.gamma(2, 100, 400)
    df = series(spark, [float(x) for x in y], timedelta(days=1))
    got = [r["cap"] for r in timeseries.effective_capacity(df, ["k"], "ts", "y", 30, 0.999, 10).orderBy("ts").collect()]
    top = None
    for i in range(400):
        own = y[max(0, i - 30) : i]
        q = float(np.quantile(own, 0.999)) if len(own) >= 10 else None
        top = q if top is None else max(top, q) if q is not None else top
        assert (got[i] is None) == (top is None) and (top is None or abs(got[i] - top) < 1e-9)


def test_spring_gap_raises(spark):
    df = spark.createDataFrame([(0, 0, datetime(2024, 3, 31, 2, 30))], "file int, line int, local timestamp_ntz")
    with pytest.raises(Exception, match="no such local time"):
        timeseries.localize(df, ["file"], "local", "line").collect()


def test_hour_ceiling(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(microseconds=1),), (T0 + timedelta(minutes=59, seconds=59, microseconds=999999),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(hour_ceil("ts")).collect()] == [T0, T0 + timedelta(hours=1), T0 + timedelta(hours=1)]


def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-60, 70, 300) // 1 * 0.02 + 50, rng.uniform(0, 3, 300), strict=True))] + [(900, 50.0, 1.0), (901, 50.0, 1.0), (902, 50.0, 1.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = spatial.density_clusters(df, "id", 5.0).collect()

    def km(p, q):
        a, b, c, d = map(np.radians, (p[1], p[2], q[1], q[2]))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        return 2 * 6371.0088 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    label = {p[0]: p[0] for p in pts}
    links = [(p[0], q[0]) for i, p in enumerate(pts) for q in pts[:i] if km(p, q) <= 5.0]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    order = {c: i for i, c in enumerate(sorted(set(label.values())))}
    assert {r["id"]: r["cluster"] for r in got} == {i: order[c] for i, c in label.items()}


def test_power_curve_edges(spark):
    curve = spark.createDataFrame([(1, v, kw) for v, kw in [(3.0, 0.0), (13.0, 2000.0), (25.0, 2000.0)]], "c int, v double, kw double")
    df = spark.createDataFrame([(1, v) for v in (0.0, 2.9, 3.0, 8.0, 13.0, 25.0, 25.1, None)], "c int, v_in double")
    got = [r["kw"] for r in physics.power_at(df, curve, ["c"]).orderBy(F.asc_nulls_last("v_in")).collect()]
    assert got == [0.0, 0.0, 0.0, 1000.0, 2000.0, 2000.0, 0.0, None]
    cubic = physics.cubic_power_at(df, [3.0, 13.0, 25.0], [0.0, 2000.0, 2000.0]).orderBy(F.asc_nulls_last("v_in")).collect()
    assert [round(r["kw"], 6) if r["kw"] is not None else None for r in cubic if r["v_in"] in (3.0, 13.0, 25.0, 0.0, None)] == [0.0, 0.0, 2000.0, 2000.0, None]
    long = physics.segments(curve, ["c"]).orderBy("va").collect()
    assert [r["closed"] for r in long] == [False, True]


def test_all_null_hours_sum_to_zero(spark):
    per = spark.createDataFrame([(1, T0, None), (1, T0 + timedelta(hours=1), 0.5)], "node int, ts timestamp_ntz, pu double")
    cap = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 9.0)], "node int, capacity_mw double")
    got = physics.regional_sum(per, cap, ["node"], "ts", "pu").orderBy("ts").collect()
    assert [r["prior_mw"] for r in got] == [0.0, 2.5]


def test_affine_and_conformal(spark):
    rng = np.random.default_rng(3)
    b = rng.uniform(0, 100, 500)
    df = spark.createDataFrame([("a", float(2 * x + 300 + e), float(x)) for x, e in zip(b, rng.normal(0, 1, 500), strict=True)] + [("flat", 5.0, 1.0)] * 3 + [("one", 4.0, 1.0)], "k string, y double, base double")
    got = {r["k"]: r for r in calibrate.fit_affine(df, ["k"]).collect()}
    assert abs(got["a"]["scale"] - 2) < 0.01 and abs(got["a"]["offset"] - 300) < 1 and (got["flat"]["scale"], got["flat"]["offset"]) == (1.0, 4.0) and got["one"]["offset"] == 3.0
    y = rng.gamma(2, 500, 4000)
    rows = spark.createDataFrame([("g", i // 2000, float(v), 900.0, 1100.0) for i, v in enumerate(y)] + [("zero", 0, 0.0, 0.0, 0.0)] * 5, "k string, fold int, y double, lo double, hi double")
    fit = {r["k"]: r for r in calibrate.fit_conformal(rows, ["k"]).collect()}
    assert (fit["zero"]["q"], fit["zero"]["w_floor"]) == (0.0, 0.0)
    seq = calibrate.sequential_conformal(rows, ["k"]).collect()
    assert len(seq) == 1 and abs(seq[0]["picp_after"] - 0.8) < 0.04 and seq[0]["picp_before"] < 0.3
    e = np.maximum(900 - y, y - 1100) / 100
    want = np.sort(e)[int(np.ceil(min(np.ceil(4001 * 0.8) / 4000, 1) * 3999))]
    lo, hi = calibrate.apply_conformal("lo", "hi")
    out = rows.filter("k = 'g'").crossJoin(spark.createDataFrame([(fit["g"]["q"], fit["g"]["w_floor"])], "q double, w_floor double")).select(lo.alias("l"), hi.alias("h")).first()
    assert abs(out["h"] - (1100 + want * 100)) < 1e-6 and abs(out["l"] - max(900 - want * 100, 0)) < 1e-6


def test_significance_against_numpy(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(0, 1, 3000)
    bad = good + rng.normal(0, 0.6, 3000)
    y = rng.uniform(5, 10, 3000)
    df = spark.createDataFrame([("a", T0 + timedelta(hours=i), float(y[i]), float(good[i]), float(bad[i])) for i in range(3000)], "k string, ts timestamp_ntz, y double, err_a double, err_b double")
    dm = significance.diebold_mariano(df, ["k"]).first()
    d = np.abs(good) - np.abs(bad)
    c = d - d.mean()
    lags = int(np.floor(3000 ** (1 / 3)))
    s = np.mean(c * c) + 2 * sum((1 - k / (lags + 1)) * np.mean(c[k:] * c[:-k]) for k in range(1, lags + 1))
    assert abs(dm["stat"] - d.mean() / np.sqrt(s / 3000)) < 1e-9 and dm["p"] < 0.01
    same = significance.diebold_mariano(df.withColumn("err_b", F.col("err_a")), ["k"]).first()
    assert same["stat"] is None and same["p"] is None
    boot = significance.block_bootstrap(df, ["k"], block=48, reps=200).first()
    assert abs(boot["point"] - d.mean() / y.mean()) < 1e-9 and boot["lo"] < boot["point"] < boot["hi"] < 0
    assert significance.block_bootstrap(df.limit(50), ["k"], block=48, reps=10).first()["lo"] is None
    assert abs(significance.student_p(2.0, 10) - 0.07338803) < 1e-7 and significance.student_p(0.0, 5) == 1.0
    assert significance.sign_p(0, 4) == 0.125 and significance.sign_p(2, 4) == 1.0 and significance.sign_p(1, 0) is None


def test_folds(spark):
    df = spark.createDataFrame([(T0 + timedelta(days=i),) for i in range(1500)], "ts timestamp_ntz")
    b = folds.fold_bounds(df)
    rows = {(r["fold"], r["role"]): r for r in folds.summary(folds.assign(df, b)).collect()}
    for k in range(1, 5):
        assert rows[k, "test"]["n"] == 365 and (rows[k, "test"]["first_ts"] - rows[k, "train"]["last_ts"]).days >= 3
        assert k == 1 or rows[k, "test"]["first_ts"] > rows[k - 1, "test"]["last_ts"]
    with pytest.raises(Exception, match="too short"):
        folds.fold_bounds(df.limit(1000)).collect()


def test_metrics_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", None, 1.0), ("a", float("inf"), 1.0), ("z", 0.0, 1.0), ("z", 0.0, 2.0)], "k string, y double, p double")
    got = {r["k"]: r for r in metrics.errors(df, ["k"]).collect()}
    assert (got["a"]["n"], got["a"]["mae"], got["a"]["nmae"]) == (2, 0.0, 0.0) and abs(got["a"]["corr"] - 1) < 1e-12
    assert got["z"]["nmae"] is None and got["z"]["corr"] is None and got["z"]["mae"] == 1.5


def test_forecast_rules(spark):
    q = spark.createDataFrame([("a", T0, 0.5, 0.3, 0.1, 10.0, 1.0, 0.0, 0.5, 200.0), ("b", T0, 0.1, 0.3, 0.5, 10.0, 1.0, 0.0, 0.0, 200.0)], "d string, ts timestamp_ntz, q10 double, q50 double, q90 double, cap_mw double, scale double, offset double, conformal_q double, conformal_floor double")
    got = {r["d"]: r for r in forecast.downscale(q).collect()}
    assert (got["b"]["lower_mw"], got["b"]["median_mw"], got["b"]["upper_mw"]) == (1.0, 3.0, 5.0)
    assert got["a"]["lower_mw"] == 0.0 and got["a"]["median_mw"] == 3.0 and got["a"]["upper_mw"] == 6.0
    reg = spark.createDataFrame([("a",), ("b",), ("c",)], "d string")
    with pytest.raises(Exception, match="incomplete forecast: c"):
        forecast.complete(q, reg, "d", 1).collect()
    assert forecast.complete(q, reg.filter("d <> 'c'"), "d", 1).count() == 2


def test_learners_rank_as_expected(spark):
    rng = np.random.default_rng(5)
    rows = [(T0 + timedelta(days=i), float(x), float(z), float(np.clip(0.3 * x + 0.1 * z, 0, 1.5))) for i, (x, z) in enumerate(rng.uniform(0, 2, (900, 2)))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, prior double, z double, cf double")
    b = folds.fold_bounds(df, n=2, test_days=200)
    got = {r["model"]: r["nmae"] for r in ml.ablation(df, b, ml.linear(), ["prior", "z"], ["prior"], "cf", "lin").groupBy("model").agg(F.avg("nmae").alias("nmae")).collect()}
    assert got["lin_full"] < 1e-6 < got["lin_prior_only"] < got["lin_no_prior"] and got["raw_prior"] > got["lin_full"]
    gap = {r["input"]: r for r in ml.input_gap(df, df.withColumn("prior", F.col("prior") + 0.1), b, ml.linear(), ["prior", "z"], "cf").collect()}
    assert gap["forecast"]["mae"] > gap["analysis"]["mae"]
    s = ml.population_scaler(df, ["prior"])["prior"]
    assert abs(s[1] - np.std([r[1] for r in rows])) < 1e-9


def test_schema_contract(spark):
    for ddl in schemas.DDL.values():
        assert isinstance(T._parse_datatype_string(ddl), T.StructType)
    assert schemas.known_reals("solar")[0] == "solar_prior_cf" and len(schemas.known_reals("wind")) == 8
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert schemas.available(df, "b", "x", "a").columns == ["b", "a"]
    with pytest.raises(ValueError, match="x"):
        schemas.require(df, "a", "x")


def test_imputation_uses_both_coordinates(spark):
    df = spark.createDataFrame([(1, "01", None, 9.0), (2, "99", 50.0, None), (3, "01", 51.0, 10.0)], "id int, plz string, lat double, lon double")
    post = spark.createDataFrame([("01", 1.0, 2.0, 0), ("01", 3.0, 4.0, 1)], "plz string, lat double, lon double, ord int")
    got = {r["id"]: (r["lat"], r["lon"], r["imputed"]) for r in clean.impute_coordinates(df, post, "plz", (52.0, 13.0)).collect()}
    assert got == {1: (1.0, 2.0, True), 2: (52.0, 13.0, True), 3: (51.0, 10.0, False)}
