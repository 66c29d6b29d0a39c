"""The SQL functions by themselves: plans stay in the JVM, rings and times at their edges."""

from quadrille.functions import sql


def test_functions_are_written_into_the_plan(spark):
    sql.register(spark)
    df = spark.sql("SELECT cell_of(id / 7.0D, -id / 3.0D, 0.5D) AS c, km_between(0D, 0D, 1D, CAST(id AS DOUBLE)) AS km, cell_ring(cell_of(0.1D, -0.1D, 0.5D), 1) AS r FROM range(5)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [r.c for r in df.collect()] == ["0_0", "0_-1", "0_-2", "0_-2", "1_-3"] and sorted(df.first().r) == sorted(f"{i}_{j}" for i in (-1, 0, 1) for j in (-2, -1, 0))


def test_times_and_points(spark):
    sql.register(spark)
    r = spark.sql("""SELECT utc_time(timestamp_ntz'2024-03-10 02:30:00', 'America/New_York') AS skipped, utc_time(timestamp_ntz'2024-11-03 01:30:00', 'America/New_York') AS twice, local_time(timestamp_ntz'2024-11-03 05:30:00', 'America/New_York') AS local,
        bins_between(timestamp_ntz'2024-01-01 23:59:59.5', timestamp_ntz'2024-01-02 00:15:00', 15) AS bins, polyline_points(' 1,2  x,3 4,5,6\t7') AS pts, cell_lat('2_-3', 0.5D) AS lat, cell_lng('2_-3', 0.5D) AS lng""").first()
    assert (str(r.skipped), str(r.twice), str(r.local)) == ("2024-03-10 07:30:00", "2024-11-03 05:30:00", "2024-11-03 01:30:00")
    assert [str(b)[11:16] for b in r.bins] == ["23:45", "00:00", "00:15"] and [tuple(p) for p in r.pts] == [(1.0, 2.0), (4.0, 5.0)] and (r.lat, r.lng) == (1.25, -1.25)


def test_gaps_of_each_series(spark):
    sql.register(spark)
    spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01 00:00:00'), ('a', timestamp_ntz'2024-01-01 01:00:00'), ('b', timestamp_ntz'2024-01-01 00:30:00'), ('a', timestamp_ntz'2024-01-01 00:15:00') t(s, ts)").createOrReplaceTempView("some_bins")
    got = spark.sql("SELECT * FROM bin_gaps(TABLE(some_bins) PARTITION BY s ORDER BY (ts), 15)").collect()
    assert [(r.series, str(r.gap_start)[11:16], str(r.gap_end)[11:16], r.missing) for r in got] == [("a", "00:30", "00:45", 2)]
