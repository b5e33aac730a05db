import itertools

import numpy as np
import pytest
from gridcast.plans import additive as A
from gridcast.plans import ml
from pyspark.sql import functions as F


def data(seed, n=2400):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 1, n)
    b = 0.7 * a + 0.3 * rng.uniform(0, 1, n)  # goes along with a, which one pass mistakes for it
    c = rng.uniform(0, 1, n)
    y = np.sin(6 * a) + (b > 0.5) - 2 * c * (a > 0.5) + rng.normal(0, 0.2, n)
    return np.stack([a, b, c], 1), y


def one_pass(x, y, test, bins=16):
    """Means of what the features before left over, bin by bin, each feature once."""
    base = y.mean()
    rest, out = y - base, np.full(len(test), base)
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins))
        at, n = np.searchsorted(cuts, x[:, f]), len(cuts) + 1
        mean = np.bincount(at, rest, n) / np.maximum(np.bincount(at, minlength=n), 1)
        rest = rest - mean[at]
        out += mean[np.searchsorted(cuts, test[:, f])]
    return out


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")


def test_no_fold_is_worse_than_one_pass(spark):
    x, y = data(1)
    for fold in range(3):
        test = np.arange(len(y)) % 3 == fold
        model = ml.additive()(frame(spark, x[~test], y[~test]), ["a", "b", "c"], "y")
        got = model.base + model.effects(x[test]).sum(1)
        rmse = lambda p: np.sqrt(np.mean((p - y[test]) ** 2))  # noqa: E731, B023
        assert rmse(got) <= rmse(one_pass(x[~test], y[~test], x[test]))


def test_tables_are_centred_saved_and_tell_importance(spark, tmp_path):
    x, y = data(2)
    x[::50, 0] = np.nan
    df = frame(spark, x, y).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    model = ml.additive(pairs=2)(df, ["a", "b", "c"], "y")
    effects = model.effects(x)
    assert effects.shape[1] == 5 and np.allclose(effects.mean(0), 0, atol=1e-9) and abs(model.base - y.mean()) < 1e-9
    assert model.pairs[0] == (0, 2) or model.pairs[0] == (1, 2)  # what c does depends on a, with which b goes along
    got = {r["feature"]: r["importance"] for r in model.importance().collect()}
    assert list(got) == model.names() and np.allclose(list(got.values()), np.abs(effects).mean(0))
    model.save(str(tmp_path / "m"))
    held = A.Additive.load(str(tmp_path / "m"))
    rows = held(df).toPandas()
    assert np.allclose(np.sort(rows.pred), np.sort(model.base + effects.sum(1)))
    plain = ml.additive()(df, ["a", "b", "c"], "y")
    assert ((rows.y - rows.pred) ** 2).mean() < ((y - plain.base - plain.effects(x).sum(1)) ** 2).mean()
    shape = held.shape().collect()
    assert sum(r["n"] for r in shape if r["feature"] == "a") == len(y) and next(r["n"] for r in shape if r["feature"] == "a" and r["bin"] == 0) == len(x[::50])


@pytest.mark.parametrize("leaves", [1, 2, 3])
def test_levels_split_where_it_gains_most(leaves):
    rng = np.random.default_rng(leaves)
    n, s = rng.integers(0, 9, 14).astype(float), rng.normal(0, 4, 14)
    s[n == 0] = 0
    got = A.levels(s, n, leaves, 3)
    assert got[0] == (s[0] / n[0] if n[0] >= 3 else 0)
    if leaves == 2:
        gains = {k: s[1:k].sum() ** 2 / n[1:k].sum() + s[k:].sum() ** 2 / n[k:].sum() for k in range(2, 14) if n[1:k].sum() >= 3 and n[k:].sum() >= 3}
        k = max(gains, key=gains.get)
        assert np.allclose(got[1:k], s[1:k].sum() / n[1:k].sum()) and np.allclose(got[k:], s[k:].sum() / n[k:].sum())
    assert len([1 for _ in itertools.groupby(got[1:])]) <= leaves


def test_tasks_agree_and_empty_tables(spark):
    x, y = data(3, 300)
    df = frame(spark, x, y)
    how = A.Shape(rounds=3, bags=2)
    one, two = ml.additive(how=how, pairs=1)(df, ["a", "b", "c"], "y"), ml.additive(how=how, pairs=1, per_task=150)(df, ["a", "b", "c"], "y")
    assert one.pairs == two.pairs and np.allclose(one.tables, two.tables) and np.allclose(one.grids, two.grids)
    none = ml.additive(pairs=1)(df.limit(0), ["a", "b"], "y")
    assert none(df).agg(F.max(F.abs("pred"))).first()[0] == 0
