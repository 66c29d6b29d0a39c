"""Joins of places of which many stand at one coordinate: the work is that of the coordinates, the results those of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import routing, spatial


def piles(n):
    """n rows at 20 coordinates within a few km, half of them at one."""
    rng = random.Random(3)
    spots = [(40.6 + rng.uniform(0, 0.05), -74 + rng.uniform(0, 0.05)) for _ in range(20)]
    return [(i, *spots[0 if i % 2 else rng.randrange(20)]) for i in range(n)]


def sides(spark, n):
    return [spark.createDataFrame(piles(n), f"{k}_id long, {k}_lat double, {k}_lng double") for k in "ab"]


def most_joined(df):
    """The most rows that a join of the computed plan gave."""
    df.collect()
    found = []

    def walk(p):
        name = p.nodeName()
        if "Join" in name:
            found.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        for c in [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [kids.apply(i) for i in range(kids.size())]:
            walk(c)

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


def ranked(points, k, radius, itself):
    near = {}
    for i, *p in points:
        near.setdefault(tuple(p), sorted((routing.km_between(p, q), j) for j, *q in points if routing.km_between(p, q) <= radius))
    return {i: [j for _, j in near[tuple(p)] if itself or j != i][:k] for i, *p in points}


@pytest.mark.parametrize("rows", [300, 3000])
def test_nearest_joins_coordinates(spark, rows):
    got = spatial.nearest(*sides(spark, rows), 3, 2.0)
    assert most_joined(got) <= max(20 * 20 * 3, rows * 3)  # all pairs before
    want = ranked(piles(rows), 3, 2.0, True)
    assert sorted((r.a_id, r["rank"], r.b_id) for r in got.collect()) == sorted((i, n, j) for i, x in want.items() for n, j in enumerate(x, 1))


@pytest.mark.parametrize("rows", [300, 3000])
def test_graph_joins_coordinates(spark, rows):
    got = spatial.station_graph(spark.createDataFrame(piles(rows), "id long, lat double, lng double"), 2, 2.0)
    assert most_joined(got) <= max(20 * 20 * 3, rows * 3)  # all pairs before
    edges = {(i, j) for i, x in ranked(piles(rows), 2, 2.0, False).items() for j in x}
    assert sorted((r.u, r.v) for r in got.collect()) == sorted(edges | {(v, u) for u, v in edges})


def test_pairs_of_piles_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_PAIRS", 20_000, raising=False)
    monkeypatch.setattr(spatial, "PILE", 32, raising=False)
    got = spatial.within(*sides(spark, 800), 2.0)
    part = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    pts = piles(800)
    want = sorted((i, j) for i, *p in pts for j, *q in pts if routing.km_between(p, q) <= 2.0)
    assert sum(r["count"] for r in part) == len(want) and max(r["count"] for r in part) < len(want) / 5  # most of them in one task before
    assert sorted(map(tuple, got.select("a_id", "b_id").collect())) == want
    assert got.columns == ["a_id", "a_lat", "a_lng", "b_id", "b_lat", "b_lng", "km"]
