from datetime import datetime

from pyspark.sql import functions as F

from quadrille.sources import files, sinks
from quadrille.streaming import bins

HEAD = ",".join(files.RAW_TRIP_COLUMNS)


def raw(tmp_path, name="202401.csv"):
    rows = ["r1,bike,2024-01-05 10:00:00,2024-01-05 10:20:00,A,5137.10,B,0042,40.7,-74.0,40.71,-73.9,member", "r2,bike,2024-01-05 10:00:00.123,2024-01-05 10:30:00,A,NULL,B,NA,40.7,,x,-73.9,casual", "r3,bike,soon,2024-01-05 10:30:00,A,null,B,1,40.7,-74,40.7,-73.9,casual"]
    (tmp_path / name).write_text("\n".join([HEAD, *rows]) + "\n")


def test_csv_keeps_labels_and_nulls(spark, tmp_path):
    raw(tmp_path)
    got = {r.ride_id: r for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert got["r1"].start_station_id == "5137.10" and got["r1"].end_station_id == "0042"
    assert got["r2"].start_station_id is None and got["r2"].end_station_id is None and got["r2"].start_lng is None and got["r2"].end_lat is None and got["r3"].start_station_id is None


def test_ingest(spark, tmp_path):
    raw(tmp_path)
    got = {r.ride_id: r for r in files.ingest(files.read_csv(spark, str(tmp_path))).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].started_at == datetime(2024, 1, 5, 15) and got["r1"].ride_duration == 1200 and got["r1"].month == "202401"


def test_pending_files(spark, tmp_path):
    raw(tmp_path, "a.csv")
    raw(tmp_path, "b.csv")
    every = files.pending(spark, f"{tmp_path}/*.csv", None)
    assert len(every) == 2
    assert files.pending(spark, f"{tmp_path}/*.csv", spark.createDataFrame([(every[0],)], "file string")) == every[1:]


def test_months_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "202401"), (2, "202402"), (3, None)], "v int, month string")
    sinks.write_months(df, f"{tmp_path}/m")
    assert sorted(r.v for r in files.read_months(spark, f"{tmp_path}/m").collect()) == [1, 2, 3]
    assert [r.v for r in files.read_months(spark, f"{tmp_path}/m", ["202402"]).collect()] == [2]


def test_sorted_files_do_not_overlap(spark, tmp_path):
    sinks.write_sorted(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), f"{tmp_path}/s", ["v"])
    got = sorted((r.low, r.high) for r in sinks.file_order(spark.read.parquet(f"{tmp_path}/s"), "v").collect())
    assert all(a[1] < b[0] for a, b in zip(got, got[1:])) and sinks.reconcile(spark.read.parquet(f"{tmp_path}/s"), "v") == {"rows": 1000, "keys": 1000}


def test_stream_of_bins_equals_batch(spark, tmp_path):
    rows = [("a" if i % 3 else "b", datetime(2024, 1, 1, i % 5, i % 60), i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "region_id string, ts timestamp, is_pickup boolean")
    df.write.parquet(f"{tmp_path}/in")
    q = bins.region_bins(bins.event_stream(spark, f"{tmp_path}/in", df.schema)).writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.region_id, r.ts, r.pickups, r.dropoffs) for r in spark.sql("select * from bins").collect()}
    from quadrille.operators import panel

    assert got == {(r.region_id, r.ts, r.pickups, r.dropoffs) for r in panel.counts(df).collect()}


def test_incremental_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    df.write.parquet(f"{tmp_path}/in")
    for want in (1, 2):
        bins.ingest_available(bins.event_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == want
        df.write.mode("append").parquet(f"{tmp_path}/in")


def test_tensor(spark):
    p = spark.createDataFrame([("b", 1, 4), ("a", 1, 2), ("a", 2, 6), ("b", 2, 8)], "region_id string, ts int, pickups int")
    s = spark.createDataFrame([("a", 4.0, 2.0), ("b", 6.0, 2.0)], "region_id string, mean double, std double")
    assert {r.ts: r.demand for r in sinks.tensor_long(p, s).collect()} == {1: [-1.0, -1.0], 2: [1.0, 1.0]}
