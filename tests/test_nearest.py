"""Exact nearest places against all pairs."""

import numpy as np
import pytest

from quadrille.operators import nearest


def plain(points, places, k):
    out = []
    places = sorted({(int(i), float(a), float(b)) for i, a, b in places if i is not None and a is not None and b is not None and abs(a) <= 90})
    own, la, ln = (np.array(x) for x in zip(*places))
    for i, a, b in sorted({(i, a, b) for i, a, b in points if a is not None and b is not None and abs(a) <= 90}):
        km = nearest.kilometres(np.array([a]), np.array([b]), la, ln)[0]
        out += [(i, a, b, int(own[j]), n, round(float(km[j]), 9)) for n, j in enumerate(np.lexsort((own, km))[:k], 1)]
    return sorted(out)


def places_of(kind, rng):
    if kind == "clusters":  # towns at the date line, a pole and elsewhere, most places in one of them
        centre = [(0.1, 179.99), (0.1, -179.99), (89.95, 10.0), (-89.9, 0.0), (40.7, -74.0)]
        pick = rng.choice(5, 900, p=[0.05, 0.05, 0.05, 0.05, 0.8])
        return [(k, min(90.0, max(-90.0, centre[c][0] + rng.normal() * 0.05)), centre[c][1] + rng.normal() * 0.05) for k, c in enumerate(pick)]
    if kind == "piles":  # a third of all places at one spot
        return [(k, 10.0, 20.0) if k % 3 == 0 else (k, float(rng.integers(-3, 4)), float(rng.integers(-3, 4))) for k in range(600)]
    return [(k, float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for k in range(500)]


@pytest.mark.parametrize("kind", ["clusters", "piles", "globe"])
def test_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "CROWD", 50)
    rng = np.random.default_rng(5)
    places = places_of(kind, rng) + [(7000, None, 1.0), (None, 1.0, 1.0), (7001, 95.0, 1.0)]
    points = [(k, float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for k in range(80)]
    points += [(100 + k, places[k][1], places[k][2]) for k in range(60)] + [(200, -10.0, -160.0), (201, 90.0, 0.0), (202, -90.0, 55.0), (203, None, 3.0), (5, 1.0, 1.0), (5, 1.0, 1.0), (5, 2.0, 1.0)]
    p, q = spark.createDataFrame(points, "id long, lat double, lng double"), spark.createDataFrame(places, "id long, lat double, lng double")
    for k, tile in ((4, 16), (40, 7)):
        got = sorted((r.id, r.lat, r.lng, r.other, r.rank, round(r.km, 9)) for r in nearest.k_nearest(p, q, k, tile).collect())
        assert got == plain(points, places, k)


def test_few_places(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 60.0)], "id int, lat double, lng double")
    q = spark.createDataFrame([(9, 0.0, 179.0), (8, 0.0, -179.0)], "id int, lat double, lng double")
    assert [(r.id, r.other, r.rank) for r in nearest.k_nearest(p, q, 5).orderBy("id", "rank").collect()] == [(1, 8, 1), (1, 9, 2), (2, 9, 1), (2, 8, 2)]
    assert nearest.k_nearest(p, q.limit(0), 3).collect() == [] and nearest.k_nearest(p.limit(0), q, 3).collect() == []
