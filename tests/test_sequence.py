from datetime import datetime, timedelta

import numpy as np
import pytest
from gridcast.operators import timeseries
from gridcast.plans import ml, sequence
from gridcast.plans import networks as N
from gridcast.plans.gather import drive
from pyspark.sql import functions as F

T0 = datetime(2023, 1, 1)


@pytest.mark.parametrize("net", [N.BiLstm(3, 4, 0.0), N.Attention(3, 2, 8, 2, 0.0)])
def test_gradients_equal_finite_differences(net):
    rng = np.random.default_rng(1)
    params = {k: v + rng.normal(0, 0.1, v.shape) for k, v in net.start(rng).items()}
    batch, y = ([rng.normal(size=(5, 6, 3))], rng.normal(size=(5, 1))) if isinstance(net, N.BiLstm) else ([rng.normal(size=(5, 6, 3)), rng.normal(size=(5, 3, 2))], rng.normal(size=(5, 3)))
    _, got = N.gradients(net, params, batch, y)
    for name, value in params.items():
        for at in rng.choice(value.size, min(4, value.size), replace=False):
            side = []
            for step in (1e-5, -1e-5):
                moved = value.copy()
                moved.flat[at] += step
                side.append(N.gradients(net, params | {name: moved}, batch, y)[0])
            want = (side[0] - side[1]) / 2e-5
            assert abs(got[name].flat[at] - want) < 1e-4 * max(1, abs(want)), name


def test_attention_sees_no_later_step():
    net, rng = N.Attention(2, 1, 8, 2, 0.0), np.random.default_rng(2)
    params = net.start(rng)
    past, known = rng.normal(size=(3, 5, 2)), rng.normal(size=(3, 4, 1))
    one = N.predict(net, params, [past, known])
    known[:, 2:] += 5
    two = N.predict(net, params, [past, known])
    assert np.allclose(one[:, :2], two[:, :2]) and not np.allclose(one[:, 2:], two[:, 2:])
    _, weights, w_past, w_known = net.explain(N.Tape(), {k: N.Var(v) for k, v in params.items()}, [past, known])
    assert np.allclose(weights.v.sum(-1), 1) and np.allclose(w_past.v.sum(-1), 1) and np.allclose(w_known.v.sum(-1), 1)


def test_tasks_make_the_steps_of_one():
    """Two tasks with halves of every batch go the way of one with all of it (without dropout)."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(64, 4, 2)).astype(np.float32), rng.normal(size=(64, 1)).astype(np.float32)
    net, how = N.BiLstm(2, 3, 0.0), N.Training(epochs=2, batch=64, rate=0.01)
    one = N.unpacked(drive([N.learn(net, how, ([x], y), ([x], y), 0, 1, None, 2)], lambda a: a)[0])
    halves = [N.learn(net, how, ([x[i::2]], y[i::2]), ([x[i::2]], y[i::2]), i, 2, None, 2) for i in (0, 1)]
    asked = [next(h) for h in halves]
    made = [None, None]
    while None in made:
        total = asked[0].astype(np.float64) + asked[1]
        for i in (0, 1):
            try:
                asked[i] = halves[i].send(total)
            except StopIteration as end:
                made[i] = N.unpacked(end.value)
    for k, v in one.items():
        assert np.allclose(made[0][k], v, atol=1e-4) and np.array_equal(made[0][k], made[1][k])
    again = drive([N.learn(net, how, ([x], y), ([x], y), 0, 1, drive([N.learn(net, how, ([x], y), ([x], y), 0, 1, None, 1)], lambda a: a)[0], 2)], lambda a: a)[0]
    assert all(np.array_equal(v, N.unpacked(again)[k]) for k, v in one.items())  # rounds go on as one


def wave(spark, n=900):
    """A target that is the product of two features of rows before."""
    rng = np.random.default_rng(4)
    a, b = rng.choice([-1.0, 1.0], n), rng.choice([-1.0, 1.0], n)
    y = np.concatenate([[0, 0], a[:-2] * b[1:-1]]) + rng.normal(0, 0.05, n)
    return spark.createDataFrame([("s", T0 + timedelta(hours=i), *map(float, r)) for i, r in enumerate(zip(a, b, y, strict=True))], "k string, ts timestamp_ntz, a double, b double, y double")


def error(df):
    return df.agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]


def test_recurrent_learns_what_linear_cannot(spark, tmp_path):
    df = wave(spark)
    early = df.filter(F.col("ts") < F.lit(T0 + timedelta(hours=700)))
    late = df.filter(F.col("ts") >= F.lit(T0 + timedelta(hours=700)))
    how = N.Training(epochs=30, batch=64, rate=0.01, patience=30)
    model = sequence.recurrent(4, 16, 0.0, how, ("k",))(early, ["a", "b"], "y")
    rows = model(late)
    assert rows.count() == 200 - 4 and set(rows.columns) == {"k", "ts", "a", "b", "y", "pred"}
    linear = ml.sequence(ml.linear(), 4, ("k",))(early, ["a", "b"], "y")(late)
    assert error(rows) < 0.3 < 0.8 < error(linear)
    model.save(str(tmp_path / "net"))
    again = sequence.Sequenced.load(str(tmp_path / "net"))(late)
    assert [r["pred"] for r in rows.orderBy("ts").collect()] == [r["pred"] for r in again.orderBy("ts").collect()]


def test_recurrent_in_two_tasks(spark):
    model = sequence.recurrent(3, 4, 0.0, N.Training(epochs=2, batch=200), ("k",), per_task=200, per_round=1)(wave(spark, 300), ["a", "b"], "y")
    assert np.isfinite(error(model(wave(spark, 300))))


def planted(spark, n=1400, lag=7):
    """A target that repeats a feature from ``lag`` rows before."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = np.concatenate([np.zeros(lag), a[:-lag]])
    return spark.createDataFrame([("s", T0 + timedelta(hours=i), *map(float, r)) for i, r in enumerate(zip(a, b, y, strict=True))], "k string, ts timestamp_ntz, a double, b double, y double")


def test_attention_finds_a_planted_lag(spark, tmp_path):
    df = planted(spark)
    how = N.Training(epochs=40, batch=64, rate=0.01, patience=40, root=True)
    model = sequence.attentive(12, 2, 16, 2, 0.0, how, ("k",))(df, ["a", "b"], "y")
    late = df.filter(F.col("ts") >= F.lit(T0 + timedelta(hours=1300)))
    every = model.horizons(late)
    assert every.count() == 2 * (100 - 13) and {r["step"] for r in every.select("step").distinct().collect()} == {1, 2}
    got = model(late)
    assert error(got) < 0.5  # the mean absolute value of the target is 0.8
    last = {r["ts"]: r["pred"] for r in every.filter("step = 2").collect()}
    assert all(last[r["ts"]] == r["pred"] for r in got.collect())
    seen = {(r["kind"], r["name"]): r["w"] for r in model.weights(late).groupBy("kind", "name").agg(F.avg("weight").alias("w")).collect()}
    lags = {int(n): w for (k, n), w in seen.items() if k == "lag"}
    assert max(lags, key=lags.get) == 7 and abs(sum(lags.values()) - 1) < 1e-5
    assert seen[("past", "a")] > seen[("past", "b")]
    model.save(str(tmp_path / "net"))
    assert sequence.Sequenced.load(str(tmp_path / "net"))(late).agg(F.sum("pred")).first()[0] == pytest.approx(got.agg(F.sum("pred")).first()[0])


def test_windows_of_two_parts(spark):
    rows = [(k, T0 + timedelta(hours=i), float(i)) for k in "ab" for i in range(9)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double")
    got = timeseries.encoder_windows(df, ["k"], "ts", ["x"], ["x"], 4, 2, value="x").orderBy("k", "ts").collect()
    assert len(got) == 2 * 4
    first = got[0]
    assert first["past"] == [[0.0], [1.0], [2.0], [3.0]] and first["known"] == [[4.0], [5.0]] and first["goal"] == [4.0, 5.0] and first["x"] == 5.0
