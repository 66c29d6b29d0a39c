"""Joins whose frequent keys are dealt over several tasks give the rows of the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.llm import _spark, components


@pytest.mark.parametrize("listed", [100_000, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_dealt_joins_equal_plain_ones(spark, monkeypatch, listed, how):
    monkeypatch.setattr(_spark, "HEAVY_BROADCAST", listed)
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, 2, 3, 4, None]), f"v{i % 90}") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v string")
    keys = df.filter("k is null or k < 4").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    got = _spark.skew_join(df, keys, ["k"], how=how, heavy=20)
    want = df.join(keys.drop("n"), ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert _spark.skew_join(df.limit(0), keys.limit(0), ["k"], how=how).count() == 0


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(59, 130), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(60), *range(100, 131)]}
    named = spark.createDataFrame([(bytearray(b"b"), bytearray(b"a")), (bytearray(b"c"), bytearray(b"b")), (bytearray(b"x"), bytearray(b"y"))], "a binary, b binary")
    assert sorted((bytes(r.node), bytes(r.component)) for r in components.connected_components(named).collect()) == [(b"a", b"a"), (b"b", b"a"), (b"c", b"a"), (b"x", b"x"), (b"y", b"x")]
