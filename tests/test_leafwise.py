"""Leaf-wise histogram trees against a plain version on one machine, and the search of settings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import leafwise
from quadrille.operators.leafwise import Setting


def counts(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 2)
    x[rng.random(n) < 0.1, 2] = np.nan
    mean = np.exp(0.6 * (x[:, 0] > 0.3) + 0.8 * np.nan_to_num(x[:, 1]) * (x[:, 3] > 0) - 0.4 * np.isnan(x[:, 2]))
    return x, rng.poisson(mean).astype(float)


def frame(spark, x, y, parts=3):
    rows = [(*(None if math.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", y double").repartition(parts)


def plain_tree(bins, g, h, s):
    """One leaf after the other: the greatest gain over all leaves, features and cuts is taken; each is summed anew."""
    rows = {0: np.arange(bins.shape[1])}
    tree, nodes, number = {}, [0], 1

    def worth(a):
        return max(abs(g[a].sum()) - s.lambda_l1, 0) ** 2 / (h[a].sum() + s.lambda_l2)

    while len(nodes) < s.leaves:
        found = None
        for k in nodes:
            r = rows[k]
            for f in range(len(bins)):
                for cut in range(int(bins.max())):
                    a, b = r[bins[f, r] <= cut], r[bins[f, r] > cut]
                    if min(len(a), len(b)) < s.least_rows:
                        continue
                    gain = worth(a) + worth(b) - worth(r)
                    if found is None or gain > found[0] + 1e-7:
                        found = (gain, k, f, cut, a, b)
        if found is None:
            break
        gain, k, f, cut, rows[number], rows[number + 1] = found
        tree[k] = (f, cut, number, number + 1)
        nodes = [x for x in nodes if x != k] + [number, number + 1]
        number += 2
    return tree, {k: -s.rate * np.sign(g[rows[k]].sum()) * max(abs(g[rows[k]].sum()) - s.lambda_l1, 0) / (h[rows[k]].sum() + s.lambda_l2) for k in nodes}


def splits(tree, node=0):
    """A tree as nested (feature, cut, left, right) or a value."""
    if node not in tree[0]:
        return round(tree[1][node], 3)
    f, cut, a, b = tree[0][node]
    return (f, cut, splits(tree, a), splits(tree, b))


@pytest.mark.parametrize("change", [{}, {"lambda_l1": 3.0, "lambda_l2": 2.0, "leaves": 5}, {"objective": "squared"}])
def test_splits_of_a_plain_version(spark, change):
    x, y = counts(700)
    s = Setting(**{"rounds": 2, "leaves": 8, "least_rows": 15, "bins": 12, **change})
    model = leafwise.fit(frame(spark, x, y), None, [f"x{i}" for i in range(5)], "y", s)
    bins = leafwise.binned(x, model.edges)
    raw = np.full(len(y), model.base)
    for t in model.trees:
        g, h = leafwise.slopes(s.objective, raw, y)
        want = plain_tree(bins, g, h, s)
        got = ({i: (t.feature[i], t.cut[i], t.left[i], t.right[i]) for i in range(len(t.left)) if t.left[i] >= 0}, t.value)
        assert splits(got) == splits(want)
        raw = leafwise.add_trees(raw, [t], bins)
    assert len(model.trees) == 2


def test_same_model_however_rows_are_dealt(spark):
    x, y = counts(1500)
    s = Setting(rounds=3, leaves=6, bagging_fraction=0.7, feature_fraction=0.6)
    a, b = (leafwise.fit(frame(spark, x, y, n), None, [f"x{i}" for i in range(5)], "y", s) for n in (1, 7))
    assert [(t.feature, t.cut, t.value) for t in a.trees] == [(t.feature, t.cut, t.value) for t in b.trees]


def test_many_rounds_stop_early_and_beat_the_mean(spark, monkeypatch):
    monkeypatch.setattr(leafwise, "REFRESH", 4)
    x, y = counts(4000)
    names = [f"x{i}" for i in range(5)]
    train, valid = frame(spark, x[:2500], y[:2500]), frame(spark, x[2500:], y[2500:])
    m = leafwise.fit(train, valid, names, "y", Setting(rounds=60, rate=0.4, leaves=8, patience=4))
    assert 5 <= len(m.trees) < 60 and len(m.history) == len(m.trees) + 4 and min(m.history) == m.history[len(m.trees) - 1]
    raw = m.raw(leafwise.binned(x[2500:], m.edges))
    assert abs((np.exp(raw) - y[2500:] * raw).mean() - min(m.history)) < 1e-3  # scores written down and trees applied anew agree
    got = leafwise.score(m, valid).select("y", "predicted").toPandas()
    assert np.abs(got.predicted - got.y).mean() < 0.93 * np.abs(y[2500:] - y[:2500].mean()).mean()
    assert {n for n, _ in m.importances()[:3]} == {"x0", "x1", "x3"}


def test_odd_tables(spark):
    x, y = counts(60)
    names = [f"x{i}" for i in range(5)]
    one = leafwise.fit(frame(spark, x[:1], y[:1]), None, names, "y", Setting(rounds=3))
    assert one.trees == [] and leafwise.score(one, frame(spark, x, y)).count() == 60
    none = leafwise.fit(frame(spark, x, y).limit(0), None, names, "y", Setting(rounds=3))
    assert none.trees == [] and none.predict(x).shape == (60,)
    blank = frame(spark, x, y).withColumn("x1", F.lit(None).cast("double"))
    assert leafwise.fit(blank, None, names, "y", Setting(rounds=2, least_rows=5)).edges[1].size == 0


def test_queries_beat_the_naive_forecast_and_the_grid(spark):
    from quadrille.plans import catalog

    got = {(r.kind, r.model): r.mae for r in catalog.QUERIES["leafwise_trees_eval"](spark, "/root/testdata/sf0.01").collect()}
    assert got["pickup", "leafwise_trees"] < got["pickup", "same_day"] and got["dropoff", "leafwise_trees"] < got["dropoff", "same_day"]
    rows = catalog.QUERIES["parzen_search_eval"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 16 and min(r.mae for r in rows if r.search == "parzen") < min(r.mae for r in rows if r.search == "grid")
