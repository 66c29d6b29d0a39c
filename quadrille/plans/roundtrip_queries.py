"""Queries that write a given table in each of the engine's forms and read it back, and rules of time over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions import text, timeutil
from quadrille.operators import spatial
from quadrille.plans.context_queries import STATIONS, stations
from quadrille.plans.registry import query, table
from quadrille.sources import files, sinks
from quadrille.storage import new_path


_RAW = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("balance", T.DoubleType()), T.StructField("day", T.DateType())])


@query("""SELECT printf('%05d.%02d', c_custkey, c_custkey % 100) AS id, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE strftime(DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER), '%Y-%m-%d') END AS day FROM customer""")
def csv_round_trip(spark, d):
    """Customers as CSV with all null tokens and labels that look like numbers, read under an explicit schema."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.format_string("%05d.%02d", k, k % 100).alias("id"), F.when(k % 7 == 0, "NULL").when(k % 11 == 0, "null").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 5 == 0, "NA").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.when(k % 3 == 0, "").otherwise(F.date_add(F.lit(date(2024, 1, 1)), (k % 60).cast("int")).cast("string")).alias("day"))
    path = new_path(spark, "csv")
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    return files.read_csv(spark, path, _RAW).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y%m') END AS month, o_totalprice FROM orders")
def month_round_trip(spark, d):
    """Orders in one directory a month, the null month among them, written in two runs and read by partition discovery."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate", "yyyyMM")).alias("month"), "o_totalprice")
    path = new_path(spark, "months")
    for half in (0, 1):
        sinks.write_months(rows.filter(F.col("o_orderkey") % 2 == half), path)
    return spark.read.parquet(path).select("o_orderkey", F.col("month").cast("string").alias("month"), "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y%m') IN ('199701', '199702', '200003')")
def months_read(spark, d):
    """Chosen months of partitioned orders, without the partition column, and the empty relation of their schema."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyyMM").alias("month"))
    path = new_path(spark, "months")
    sinks.write_months(rows, path)
    got = files.read_months(spark, path, ["199701", "199702", "200003"])
    return got.unionByName(files.empty_like(got))


@query("""WITH m AS (SELECT event_id, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS ts, event_type AS region_id, value FROM events) SELECT region_id, strftime(ts, '%Y%m') AS month, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 2) AS value FROM m GROUP BY 1, 2""")
def panel_round_trip(spark, d):
    """A panel's rows written by month, sorted by region and time, and read back."""
    path = new_path(spark, "panel")
    sinks.write_panel(table(spark, d, "events").select("event_id", timeutil.bin_start("ts", 15).alias("ts"), F.col("event_type").alias("region_id"), "value"), path)
    back = spark.read.parquet(path)
    return back.groupBy("region_id", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT count(*) AS n_rows, min(o_totalprice) AS low, max(o_totalprice) AS high, 0::BIGINT AS overlaps FROM orders")
def sorted_round_trip(spark, d):
    """Orders in globally sorted files: no file's range overlaps the next one's."""
    path = new_path(spark, "sorted")
    sinks.write_sorted(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), path, ["o_totalprice", "o_orderkey"])
    from pyspark.sql import Window as W

    each = sinks.file_order(spark.read.parquet(path), "o_totalprice")  # a row for each file
    before = F.max("high").over(W.partitionBy(F.lit(1)).orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1))
    return each.withColumn("crosses", F.col("low") < before).agg(F.sum("n_rows").alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.count_if("crosses").alias("overlaps"))


# the law of those years, said in SQL: clocks went forward on the first Sunday of April at 2 and back on the last of October at 2
_CHANGES = """y AS (SELECT unnest(range(1995, 2002)) AS y), s AS (SELECT make_date(y::INTEGER, 4, 1) AS a, make_date(y::INTEGER, 10, 31) AS o FROM y), c AS (SELECT a + CAST((7 - isodow(a)) AS INTEGER) AS spring, o - CAST(isodow(o) % 7 AS INTEGER) AS autumn FROM s)"""
_ORDER_TIMES = "t AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 96 * 15 AS INTEGER)) AS ts FROM orders)"
_YEARS = (date(1995, 1, 1), date(2001, 12, 31))


def order_times(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(mins=(k % 96 * 15).cast("int"))).cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {_CHANGES}, h AS (SELECT CAST(spring AS TIMESTAMP) + INTERVAL 7 HOUR AS at FROM c UNION ALL SELECT CAST(autumn AS TIMESTAMP) + INTERVAL 5 HOUR FROM c UNION ALL SELECT CAST(autumn AS TIMESTAMP) + INTERVAL 6 HOUR FROM c), {_ORDER_TIMES}
SELECT o_orderkey, ts, EXISTS (SELECT 1 FROM h WHERE t.ts >= h.at AND t.ts < h.at + INTERVAL 1 HOUR) AS dst_unreliable FROM t""")
def dst_unreliable_orders(spark, d):
    """Which orders' times, taken as UTC, lie in hours that converting local clocks distorts."""
    changes = timeutil.transitions("America/New_York", *_YEARS)
    return order_times(spark, d).withColumn("dst_unreliable", timeutil.unreliable_flag(F.col("ts"), changes))


@query(f"""WITH {_CHANGES}, {_ORDER_TIMES} SELECT {", ".join(f"count(*) FILTER (WHERE ts >= CAST((SELECT {w} FROM c WHERE year(spring) = {y}) AS TIMESTAMP) + INTERVAL {h} HOUR AND ts < CAST((SELECT {w} FROM c WHERE year(spring) = {y}) AS TIMESTAMP) + INTERVAL {h + 1} HOUR) AS {w}_{y}" for y in range(1995, 2002) for w, h in (("spring", 2), ("autumn", 1)))} FROM t""")
def affected_order_times(spark, d):
    """How many orders' times, taken as local clocks, fall into each skipped or doubled hour."""
    changes = timeutil.transitions("America/New_York", *_YEARS)
    got = timeutil.affected_counts(order_times(spark, d), ["ts"], changes)
    return got.select(*(F.col(f"ts_{t.at:%Y%m%d}").alias(f"{'spring' if t.after > t.before else 'autumn'}_{t.at.year}") for t in changes))


@query(f"""WITH s AS ({STATIONS}), g(step) AS (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)), c AS (SELECT step, floor(lat / step) AS r, floor(lng / step) AS k, count(*) AS n FROM s, g GROUP BY 1, 2, 3),
a AS (SELECT step, avg(pow(step * 6371.0088 * pi() / 180, 2) * cos(radians((r + 0.5) * step))) AS area, count(*) AS cells FROM c GROUP BY 1), o AS (SELECT area, cells FROM a WHERE step = 0.05)
SELECT a.step, a.cells, round(0.7::DOUBLE * abs(ln(a.area / o.area)) + 0.3::DOUBLE * abs(ln(a.cells::DOUBLE / o.cells)), 6) AS score FROM a, o""")
def grid_matching_stations(spark, d):
    """How far grids of several steps are from the grid of 0.05 degrees, by mean area and number of the cells that hold stations."""
    s = stations(spark, d)
    out = None
    for step in (0.02, 0.05, 0.1):
        g = spatial.SquareGrid(step)
        cells = s.select(g.index(F.col("lat"), F.col("lng")).alias("cell")).distinct()
        one = cells.agg(F.avg(g.area_km2(F.col("cell"))).alias("area"), F.count("*").alias("cells")).withColumn("step", F.lit(step))
        out = one if out is None else out.unionByName(one)
    own = out.filter("step = 0.05").select(F.col("area").alias("a"), F.col("cells").alias("n"))
    return out.join(F.broadcast(own)).select("step", "cells", F.round(0.7 * F.abs(F.ln(F.col("area") / F.col("a"))) + 0.3 * F.abs(F.ln(F.col("cells") / F.col("n"))), 6).alias("score"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, date_trunc('minute', ts) AS time, round(value, 2) AS value, event_id::DOUBLE AS event FROM events""")
def payload_days(spark, d):
    """Events packed into one JSON payload a day of parallel arrays, as a weather service answers, and read out of them."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), F.round("value", 2).alias("value"), F.col("event_id").cast("double").alias("event")).alias("r"))
    rows = e.groupBy("day").agg(F.collect_list("r").alias("r"))
    arrays = F.struct(*(F.col(f"r.{c}").alias(c) for c in ("time", "value", "event")))
    body = F.to_json(F.struct(arrays.alias("hourly")))
    got = text.hourly_payload(rows.select(body.alias("payload")), "payload", ["value", "event"])
    return got.select(F.date_format("time", "yyyy-MM-dd").alias("day"), "time", "value", "event")
