"""The segmented scan against pandas over whole series."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from quadrille.operators import scan


@pytest.mark.parametrize("block, chunk", [(128, "month"), (4, "hour")])
def test_means_of_whole_series(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(scan, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for region, n in (("a", 700), ("b", 1), ("c", 300), ("d", 40), ("e", 5)):
        at = datetime(2024, 1, 28)
        for i in range(n):
            at += timedelta(minutes=15 * int(rng.choice([1, 1, 1, 1, 40])))
            gone = (region == "c" and rng.random() < 0.6) or region == "d" or (region == "a" and i < 9)
            rows.append((region, at, None if gone else float(rng.poisson(3)), float(rng.normal()) * 10 ** float(rng.uniform(-3, 3)), i))
    df = spark.createDataFrame(rows, "region_id string, ts timestamp_ntz, x double, y double, row int").repartition(5)
    spans = [2, 4, 12, 96]
    got = scan.ewm_means(df, ["x", "y"], spans, chunk=chunk).toPandas().sort_values(["region_id", "ts"]).reset_index(drop=True)
    assert list(got.columns) == ["region_id", "ts", "x", "y", "row"] + [f"{n}_ewm{s}" for n in "xy" for s in spans] and len(got) == len(rows)
    for _, g in got.groupby("region_id"):
        for n in "xy":
            for s in spans:
                want = g[n].ewm(span=s, adjust=True, ignore_na=True).mean()
                size = g[n].abs().ewm(span=s, adjust=True, ignore_na=True).mean().fillna(0) + 1e-300
                assert (got.loc[g.index, f"{n}_ewm{s}"].isna() == want.isna()).all()
                assert ((got.loc[g.index, f"{n}_ewm{s}"] - want).abs().fillna(0) <= 1e-11 * size).all()


def test_groups_that_begin_anew_lose_nothing(spark, monkeypatch):
    """Weights that fall by 20 powers of ten a group: what is two groups back is below 1e-18 of the newest, as the bound says."""
    monkeypatch.setattr(scan, "DECADES", 20)
    monkeypatch.setattr(scan, "BLOCK", 8)
    rows = [("a", datetime(2024, 1, 1) + timedelta(minutes=15 * i), float((i * 7) % 11)) for i in range(2000)]
    df = spark.createDataFrame(rows, "region_id string, ts timestamp_ntz, x double")
    got = scan.ewm_means(df, ["x"], [4, 12], chunk="day").orderBy("ts").toPandas()
    for s in (4, 12):
        want = pd.Series([r[2] for r in rows]).ewm(span=s, adjust=True).mean()
        assert np.abs(got[f"x_ewm{s}"] - want).max() < 1e-10


def test_no_python_worker_and_no_whole_region_in_a_task(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0)], "region_id string, ts timestamp_ntz, x double")
    plan = scan.ewm_means(df, ["x"], [4])._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan
    assert scan.ewm_means(df.limit(0), ["x"], [4]).collect() == []
    with pytest.raises(ValueError):
        scan.ewm_means(df, ["x"], [1])
