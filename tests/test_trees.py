import heapq
import itertools
import math

import numpy as np
import pytest
from gridcast.plans import ml
from gridcast.plans import trees as T
from gridcast.plans.gather import drive
from pyspark.sql import functions as F



def run(learner):
    return drive([learner], lambda x: x)[0]


def plain_boost(bins, y, key, level, shape):
    """The same booster leaf by leaf, counting every candidate split by hand and sorting residuals."""
    start = np.sort(y.astype(np.float32).astype(float))[max(1, math.ceil(level * len(y) - 1e-9)) - 1]
    now = np.full(len(y), start)

    def split(own, g, columns, depth):
        best = (0.0, None)
        if depth >= shape.depth:
            return best
        for missing, f in itertools.product((False, True), columns):
            for limit in range(1, T.BINS):
                left = (bins[own, f] <= limit) & ((bins[own, f] > 0) | missing)
                n = left.sum()
                if n < shape.least or len(own) - n < shape.least:
                    continue
                gl, ga = g[left].sum(), g.sum()
                gain = gl**2 / (n + shape.l2) + (ga - gl) ** 2 / (len(own) - n + shape.l2) - ga**2 / (len(own) + shape.l2)
                if gain > best[0] + 1e-9:
                    best = (gain, (missing, f, limit))
        return best

    for step in range(shape.trees):
        rng = np.random.default_rng([shape.seed, step, round(level * 1000)])
        columns = sorted(rng.permutation(bins.shape[1])[: max(1, round(bins.shape[1] * shape.columns))].tolist())
        used = np.flatnonzero(T.mixed(key, shape.seed + step) < np.uint64(int(shape.rows * 2.0**64)))
        g = np.zeros(len(y))
        g[used] = np.where(y[used] > now[used], -level, 1 - level)
        every = np.arange(len(y))
        heap = [(-split(used, g[used], columns, 0)[0], 0, used, every, split(used, g[used], columns, 0)[1], 0)]
        done, count = [], itertools.count(1)
        while heap and len(heap) + len(done) < shape.leaves:
            gain, _, own, everyone, rule, depth = heapq.heappop(heap)
            if rule is None:
                done.append((own, everyone))
                continue
            missing, f, limit = rule
            for side in (True, False):
                goes = lambda r: ((bins[r, f] <= limit) & ((bins[r, f] > 0) | missing)) == side  # noqa: E731, B023
                sub = own[goes(own)]
                more = split(sub, g[sub], columns, depth + 1)
                heapq.heappush(heap, (-more[0], next(count), sub, everyone[goes(everyone)], more[1], depth + 1))
        add = np.zeros(len(y))
        for own, everyone in done + [(h[2], h[3]) for h in heap]:
            rest = np.sort((y[own] - now[own]).astype(np.float32).astype(float))
            add[everyone] = rest[max(1, math.ceil(level * len(rest) - 1e-9)) - 1]
        now = now + shape.rate * add
    return now


def data(n, features, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, features))
    x[rng.random((n, features)) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0], nan=0.7) + np.sin(6 * np.nan_to_num(x[:, 1 % features])) * (np.nan_to_num(x[:, -1]) > 0.4) + rng.normal(0, 0.1, n)
    cuts = [np.linspace(0, 1, 24)[1:-1]] * features
    return x, T.binned(x, cuts), y, rng.integers(0, 1 << 63, n).astype(np.uint64), cuts


@pytest.mark.parametrize("level", [0.1, 0.5])
def test_equals_a_plain_booster(level):
    _, bins, y, key, _ = data(2000, 3)
    shape = T.Shape(trees=6, rate=0.3, leaves=9, depth=4)
    start, trees = run(T.boost(bins, y, key, level, shape))
    assert np.allclose(T.score(trees, bins, start, shape.rate), plain_boost(bins, y, key, level, shape), atol=1e-6)
    for t in trees:
        assert (t["feature"] < 0).sum() <= shape.leaves and (t["cover"][t["feature"] < 0] >= shape.least).all()


def test_rounds_go_on_as_one():
    _, bins, y, key, _ = data(900, 4, 1)
    shape = T.Shape(trees=10, leaves=6)
    start, whole = run(T.boost(bins, y, key, 0.9, shape))
    first = run(T.boost(bins, y, key, 0.9, shape, upto=4))
    again = run(T.boost(bins, y, key, 0.9, shape, *first))
    assert again[0] == start and all((a[f] == b[f]).all() for a, b in zip(whole, again[1], strict=True) for f in T.FIELDS)


def test_quantiles_by_digits():
    rng = np.random.default_rng(2)
    v, group = rng.normal(0, 1e3, 5000).astype(np.float32), rng.integers(0, 7, 5000)
    v[:900] = 0
    v[900:950] = -0.0
    for level in (0.0, 0.1, 0.5, 0.93, 1.0):
        got = run(T.quantiles(v, group, 8, level))
        for g in range(7):
            own = np.sort(v[group == g])
            assert got[g] == own[max(1, math.ceil(level * len(own) - 1e-9)) - 1]
        assert got[7] == 0
    assert run(T.quantiles(np.zeros(0), np.zeros(0, np.int64), 1, 0.5)).tolist() == [0.0]


def test_shapley_values_equal_enumeration():
    """Over all subsets of five features, an absent feature's splits being averaged by the rows on either side."""
    _, bins, y, key, _ = data(1200, 5, 3)
    start, trees = run(T.boost(bins, y, key, 0.5, T.Shape(trees=4, rate=0.5, least=20, columns=1.0)))

    def value(tree, n, row, known):
        f = tree["feature"][n]
        if f < 0:
            return tree["value"][n]
        left, right = tree["left"][n], tree["right"][n]
        if f in known:
            return value(tree, left if T.goes_left(row[f], tree["limit"][n], tree["missing_left"][n]) else right, row, known)
        return sum(tree["cover"][c] * value(tree, c, row, known) for c in (left, right)) / tree["cover"][n]

    game = lambda row, known: start + 0.5 * sum(value(t, 0, row, known) for t in trees)
    base, got = T.shapley(trees, bins[:6], start, 0.5)
    for row, values in zip(bins[:6], got, strict=True):
        assert math.isclose(base, game(row, set()), abs_tol=1e-9)
        for i in range(5):
            rest = [j for j in range(5) if j != i]
            want = sum(math.factorial(k) * math.factorial(4 - k) / 120 * (game(row, {*s, i}) - game(row, set(s))) for k in range(5) for s in itertools.combinations(rest, k))
            assert math.isclose(values[i], want, abs_tol=1e-9)
    base, got = T.shapley(trees, bins, start, 0.5)
    assert np.allclose(base + got.sum(1), T.score(trees, bins, start, 0.5))


def frame(spark, n=1500, seed=4):
    x, _, y, _, _ = data(n, 3, seed)
    return spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, y double")


def test_tasks_agree_on_one_model(spark, tmp_path):
    """Three tasks in a barrier stage make the model that one makes; saved and loaded it predicts the same."""
    df = frame(spark)
    shape = T.Shape(trees=4, rate=0.2, leaves=9)
    one = ml.quantile_boosted((0.5,), shape)(df, ["a", "b", "c"], "y")
    three = ml.quantile_boosted((0.5,), shape, per_task=500, per_round=3)(df, ["a", "b", "c"], "y")
    assert one.starts == three.starts and all(np.array_equal(p[f], q[f]) for p, q in zip(one.trees[0], three.trees[0], strict=True) for f in T.FIELDS)
    three.save(str(tmp_path / "model"))
    held = T.QuantileTrees.load(str(tmp_path / "model"))
    want, got = (m(df).orderBy("i").select("lo", "pred", "hi").collect() for m in (one, held))
    assert want == got and set(held.gains()) == {"a", "b", "c"} and abs(sum(held.gains().values()) - 1) < 1e-9


def test_attribution_adds_up_row_by_row(spark):
    df = frame(spark, 600)
    model = ml.quantile_boosted(shape=T.Shape(trees=30, rate=0.1))(df, ["a", "b", "c"], "y")
    rows = model.attribute(df).toPandas()
    assert len(rows) == 600 and np.allclose(rows.pred - rows.base, rows.by_a + rows.by_b + rows.by_c) and rows.base.nunique() == 1
    assert "Exchange" not in model.attribute(df)._jdf.queryExecution().toString()
    raw = model.raw(df.select("a", "b", "c").toPandas().to_numpy(float))[:, 1]
    assert np.allclose(sorted(raw), sorted(rows.pred))


def test_bands_hold_on_unseen_rows(spark):
    model = ml.quantile_boosted(shape=T.Shape(trees=200, rate=0.05))(frame(spark, 2000), ["a", "b", "c"], "y")
    rows = model(frame(spark, 1000, 9)).toPandas()
    assert ((rows.lo <= rows.pred) & (rows.pred <= rows.hi)).all()
    assert 0.7 <= ((rows.y >= rows.lo) & (rows.y <= rows.hi)).mean() <= 0.9


def test_no_rows_and_missing_columns(spark):
    df = frame(spark, 300)
    empty = ml.quantile_boosted(shape=T.Shape(trees=3))(df.limit(0), ["a", "b"], "y")
    assert empty(df).agg(F.max(F.abs("pred"))).first()[0] == 0
    blank = df.withColumn("b", F.lit(None).cast("double"))
    assert ml.quantile_boosted(shape=T.Shape(trees=3))(blank, ["a", "b"], "y")(blank).filter("pred IS NULL").count() == 0
    assert ml.quantile_boosted(shape=T.Shape(trees=3))(df.withColumn("y", F.when(F.col("i") > 5, F.col("y"))), ["a"], "y")(df).count() == 300
