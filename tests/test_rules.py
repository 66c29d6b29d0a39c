from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quadrille.operators import rules as R

D = datetime(2024, 6, 3, 12)
SCHEMA = "ride_id string, started_at timestamp_ntz, ended_at timestamp_ntz, ride_duration long, start_lat double, start_lng double, end_lat double, end_lng double, start_station_id string, end_station_id string, want string"


def ride(i, want, a=D, b=datetime(2024, 6, 3, 12, 20), s=1200, lat=40.7, lng=-74.0, lat2=40.71, lng2=-73.99, st="a", en="b"):
    return (i, a, b, s, lat, lng, lat2, lng2, st, en, want)


ROWS = [
    ride("1", None), ride("2", None, st="a", en="a"), ride("3", None, st=None), ride(None, "null_ride_id"), ride("4", "null_timestamp", a=None), ride("5", "outside_project_window", a=datetime(2023, 1, 1), b=datetime(2023, 1, 2)),
    ride("6", "outside_project_window", a=datetime(2025, 1, 1, 5), b=datetime(2025, 1, 2)), ride("7", "end_before_start", b=D, s=0), ride("8", "duration_too_short", s=59), ride("9", None, s=60), ride("10", "duration_too_long", s=86401), ride("11", None, s=86400),
    ride("12", "missing_coords", lng2=None), ride("13", "coords_out_of_bbox", lat=41.5), ride(None, "null_ride_id", s=1)]


@pytest.fixture()
def labelled(spark):
    rs = R.trip_rules(date(2024, 1, 1), date(2024, 12, 31), "America/New_York", (40.4, -74.3, 41.0, -73.6))
    return R.label(spark.createDataFrame(ROWS, SCHEMA), rs), rs


def test_first_broken_rule(labelled):
    assert all(r.drop_reason == r.want for r in labelled[0].collect())


def test_waterfall_reconciles(labelled):
    got = {r.name: r.n for r in R.waterfall(*labelled).collect()}
    assert got["TOTAL REMOVED"] + got["KEPT"] == len(ROWS) and got["null_ride_id"] == 2 and got["missing_coords"] == 1
    assert sum(v for k, v in got.items() if k not in ("TOTAL REMOVED", "KEPT")) == got["TOTAL REMOVED"]


def test_repeats_are_charged_first(spark):
    rs = R.trip_rules(date(2024, 1, 1), date(2024, 12, 31), "America/New_York", (40.4, -74.3, 41.0, -73.6))
    rows = ROWS + [ride("1", "duplicate_ride_id", a=datetime(2024, 6, 4), b=datetime(2024, 6, 4, 1)), ride("8", "duplicate_ride_id", a=datetime(2024, 6, 4), b=datetime(2024, 6, 4, 1), s=3)]
    marked = R.mark_repeats(spark.createDataFrame(rows, SCHEMA), ["ride_id"], [F.col("started_at").asc_nulls_last()], rs, "duplicate_ride_id")
    assert all(r.drop_reason == r.want for r in marked.collect()) and marked.count() == len(rows)
    got = [(r.name, r.n) for r in R.waterfall(marked, rs, ["duplicate_ride_id"]).orderBy("step").collect()]
    assert got[0] == ("duplicate_ride_id", 2) and dict(got)["TOTAL REMOVED"] + dict(got)["KEPT"] == len(rows)


def test_waterfall_of_nothing(spark, labelled):
    empty = spark.createDataFrame([], labelled[0].schema)
    assert all(r.n == 0 and r.pct is None for r in R.waterfall(empty, labelled[1]).collect())


def test_dedupe_keeps_the_first_and_all_null_keys(spark):
    df = spark.createDataFrame([("a", 2, 1500), ("a", 1, 1200), ("b", None, 1), ("b", 5, 2), (None, 1, 1), (None, 1, 2)], "k string, o int, v int")
    got = sorted((r.k or "", r.v) for r in R.keep_first(df, ["k"], [F.col("o").asc_nulls_last()]).collect())
    assert got == [("", 1), ("", 2), ("a", 1200), ("b", 2)]
    assert tuple(R.duplicates_removed(df, ["k"]).first()) == (2, 2)


def test_flags(spark):
    got = {r.ride_id: (r.missing_station_id, r.is_round_trip) for r in R.with_flags(spark.createDataFrame(ROWS, SCHEMA)).filter("ride_id in ('1', '2', '3')").collect()}
    assert got == {"1": (False, False), "2": (False, True), "3": (True, False)}


def test_traffic_rules(spark):
    t = datetime(2024, 6, 1)
    rows = [("x", t, "0", 30.0, 5.0, None), ("x", None, "0", 30.0, 5.0, "null_timestamp"), (None, t, "0", 30.0, 5.0, "null_link_id"), ("x", datetime(2020, 1, 1), "0", 30.0, 5.0, "outside_project_window"),
            ("x", t, "-101", 30.0, 5.0, "invalid_status"), ("x", t, "0", 0.0, 5.0, "speed_out_of_range"), ("x", t, "0", 150.0, 5.0, "speed_out_of_range"), ("x", t, "0", 30.0, 0.0, "travel_time_nonpositive")]
    df = spark.createDataFrame(rows, "link_id string, data_as_of timestamp_ntz, status string, speed double, travel_time double, want string")
    assert all(r.drop_reason == r.want for r in R.label(df, R.traffic_rules(date(2024, 1, 1), date(2024, 12, 31))).collect())


def test_sortedness(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 4)], "o int, v int")
    for width in (1, 2, 3, 100):
        assert tuple(R.sortedness(df, "o", "v", F.floor(F.col("o") / width)).first()) == (4, 1)
    assert tuple(R.sortedness(df.limit(0), "o", "v").first()) == (0, 0)


def test_quantiles_of_many_equal_values(spark):
    import numpy as np

    from quadrille.operators import quality

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 9, 500).astype(float), rng.normal(size=301)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "value double")
    q = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.999, "e": 1.0}
    r = quality.quantiles(df, "value", q).first()
    assert all(abs(r[k] - np.quantile(x, p)) < 1e-5 for k, p in q.items()) and abs(r["mean"] - x.mean()) < 1e-5
    assert set(quality.quantiles(df.filter("value is null"), "value", q).first()) == {None}
