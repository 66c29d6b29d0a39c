"""Queries on cleaning, profiles and registries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from quadrille.functions import timeutil
from quadrille.operators import quality, rules
from quadrille.plans.registry import query, table

LAT = "40.55 + ((user_id * 37) % 450) / 1000"
# trips made from events, with faults at fixed ids; the box leaves some stations out
TRIPS = """trips AS (SELECT CASE WHEN event_id % 97 = 3 THEN NULL ELSE CAST(event_id - event_id % 50 // 49 AS VARCHAR) END AS ride_id, CASE WHEN event_id % 89 = 5 THEN NULL ELSE ts END AS started_at,
ts + CAST(CASE WHEN event_id % 83 = 7 THEN -5 ELSE CAST(floor(value) AS BIGINT) * (CASE WHEN event_id % 79 = 2 THEN 1000 ELSE 1 END) END AS BIGINT) * INTERVAL 1 SECOND AS ended_at,
CAST(CASE WHEN event_id % 83 = 7 THEN -5 ELSE CAST(floor(value) AS BIGINT) * (CASE WHEN event_id % 79 = 2 THEN 1000 ELSE 1 END) END AS BIGINT) AS ride_duration,
CASE WHEN user_id % 11 = 0 THEN NULL ELSE 40.55::DOUBLE + ((user_id * 37) % 450)::DOUBLE / 1000 END AS start_lat, -74.15::DOUBLE + ((user_id * 53) % 450)::DOUBLE / 1000 AS start_lng,
40.55::DOUBLE + ((event_id * 31) % 450)::DOUBLE / 1000 AS end_lat, -74.15::DOUBLE + ((event_id * 29) % 450)::DOUBLE / 1000 AS end_lng,
CASE WHEN user_id % 13 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS start_station_id, CAST(event_id % 151 AS VARCHAR) AS end_station_id, event_type, event_id FROM events)"""


def trips(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    seconds = F.when(i % 83 == 7, F.lit(-5)).otherwise(F.floor("value").cast("long") * F.when(i % 79 == 2, 1000).otherwise(1)).cast("long")
    return table(spark, d, "events").select(
        F.when(i % 97 != 3, (i - F.floor(i % 50 / 49)).cast("string")).alias("ride_id"), F.when(i % 89 != 5, F.col("ts")).alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("ended_at"), seconds.alias("ride_duration"),
        F.when(u % 11 != 0, 40.55 + (u * 37 % 450) / 1000).alias("start_lat"), (-74.15 + (u * 53 % 450) / 1000).alias("start_lng"),
        (40.55 + (i * 31 % 450) / 1000).alias("end_lat"), (-74.15 + (i * 29 % 450) / 1000).alias("end_lng"),
        F.when(u % 13 != 0, u.cast("string")).alias("start_station_id"), (i % 151).cast("string").alias("end_station_id"), "event_type", "event_id")


def trip_rules():
    return rules.trip_rules(date(2024, 1, 2), date(2024, 1, 28), "America/New_York", (40.55, -74.15, 40.98, -73.72))


_REASON = """CASE WHEN ride_id IS NULL THEN 'null_ride_id' WHEN started_at IS NULL OR ended_at IS NULL THEN 'null_timestamp'
WHEN NOT CAST(started_at - INTERVAL 5 HOUR AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-28' THEN 'outside_project_window' WHEN ended_at <= started_at THEN 'end_before_start'
WHEN ride_duration < 60 THEN 'duration_too_short' WHEN ride_duration > 86400 THEN 'duration_too_long' WHEN start_lat IS NULL OR start_lng IS NULL OR end_lat IS NULL OR end_lng IS NULL THEN 'missing_coords'
WHEN NOT start_lat BETWEEN 40.55 AND 40.98 OR NOT start_lng BETWEEN -74.15 AND -73.72 OR NOT end_lat BETWEEN 40.55 AND 40.98 OR NOT end_lng BETWEEN -74.15 AND -73.72 THEN 'coords_out_of_bbox' END"""


@query(f"WITH {TRIPS} SELECT event_id, {_REASON} AS drop_reason FROM trips")
def drop_reasons(spark, d):
    return rules.label(trips(spark, d), trip_rules()).select("event_id", "drop_reason")


def _steps(names):
    return ", ".join(f"({i}::BIGINT, '{n}')" for i, n in enumerate(names))


_TRIP_RULES = ["null_ride_id", "null_timestamp", "outside_project_window", "end_before_start", "duration_too_short", "duration_too_long", "missing_coords", "coords_out_of_bbox"]


@query(f"""WITH {TRIPS}, k AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY started_at ASC NULLS LAST, ended_at ASC NULLS LAST, event_id) AS i FROM trips), u AS (SELECT * FROM k WHERE ride_id IS NULL OR i = 1),
s(step, name) AS (VALUES {_steps(['duplicate_ride_id', *_TRIP_RULES, 'KEPT'])}), g AS (SELECT coalesce({_REASON}, 'KEPT') AS name, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT 'duplicate_ride_id', (SELECT count(*) FROM trips) - (SELECT count(*) FROM u)),
f AS (SELECT s.step, s.name, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS n FROM s LEFT JOIN g USING (name) GROUP BY 1, 2), t AS (SELECT count(*) AS total FROM trips),
r AS (SELECT * FROM f UNION ALL SELECT 10, 'TOTAL REMOVED', CAST(sum(n) AS BIGINT) FROM f WHERE name <> 'KEPT') SELECT step, name, n, round(100.0::DOUBLE * n / total, 4) AS pct FROM r, t""")
def drop_waterfall(spark, d):
    """Repeated rides go first, so the table reconciles with the rows that came in."""
    order = [F.col("started_at").asc_nulls_last(), F.col("ended_at").asc_nulls_last(), F.col("event_id")]
    return rules.waterfall(rules.mark_repeats(trips(spark, d), ["ride_id"], order, trip_rules(), "duplicate_ride_id"), trip_rules(), ["duplicate_ride_id"])


READINGS = """r AS (SELECT CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS link_id, CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE l_shipdate END AS data_as_of,
CASE WHEN l_linenumber = 7 THEN '-101' ELSE '0' END AS status, CASE WHEN l_quantity > 49 THEN 150 ELSE l_quantity END AS speed, l_extendedprice - 1500 AS travel_time, l_orderkey, l_linenumber FROM lineitem)"""


def readings(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(
        F.when(F.col("l_suppkey") % 17 != 0, F.col("l_suppkey").cast("string")).alias("link_id"), F.when(F.col("l_partkey") % 101 != 0, F.col("l_shipdate")).alias("data_as_of"),
        F.when(F.col("l_linenumber") == 7, "-101").otherwise("0").alias("status"), F.when(F.col("l_quantity") > 49, 150.0).otherwise(F.col("l_quantity")).alias("speed"), (F.col("l_extendedprice") - 1500).alias("travel_time"), "l_orderkey", "l_linenumber")


_TRAFFIC_RULES = ["null_timestamp", "null_link_id", "outside_project_window", "invalid_status", "speed_out_of_range", "travel_time_nonpositive"]


@query(f"""WITH {READINGS}, s(step, name) AS (VALUES {_steps([*_TRAFFIC_RULES, 'KEPT'])}), g AS (SELECT coalesce(CASE WHEN data_as_of IS NULL THEN 'null_timestamp' WHEN link_id IS NULL THEN 'null_link_id'
WHEN NOT CAST(data_as_of AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'outside_project_window' WHEN status = '-101' THEN 'invalid_status' WHEN NOT speed BETWEEN 0.1 AND 100 THEN 'speed_out_of_range' WHEN travel_time <= 0 THEN 'travel_time_nonpositive' END, 'KEPT') AS name, count(*) AS n FROM r GROUP BY 1),
f AS (SELECT s.step, s.name, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS n FROM s LEFT JOIN g USING (name) GROUP BY 1, 2), t AS (SELECT sum(n) AS total FROM f),
w AS (SELECT * FROM f UNION ALL SELECT 7, 'TOTAL REMOVED', CAST(sum(n) AS BIGINT) FROM f WHERE name <> 'KEPT') SELECT step, name, n, round(100.0::DOUBLE * n / total, 4) AS pct FROM w, t""")
def traffic_waterfall(spark, d):
    rs = rules.traffic_rules(date(1996, 1, 1), date(2000, 12, 31))
    return rules.waterfall(rules.label(readings(spark, d), rs), rs)


@query(f"""WITH {TRIPS}, k AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY started_at ASC NULLS LAST, ended_at ASC NULLS LAST, event_id) AS i FROM trips)
SELECT event_id, ride_id FROM k WHERE ride_id IS NULL OR i = 1""")
def dedupe_keep_first(spark, d):
    order = [F.col("started_at").asc_nulls_last(), F.col("ended_at").asc_nulls_last(), F.col("event_id")]
    return rules.keep_first(trips(spark, d), ["ride_id"], order).select("event_id", "ride_id")


@query(f"WITH {TRIPS}, m AS (SELECT ride_id, count(*) AS n FROM trips WHERE ride_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS removed, count(*) AS repeated_keys FROM m")
def duplicates_removed(spark, d):
    return rules.duplicates_removed(trips(spark, d), ["ride_id"])


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, l_shipdate) IN (SELECT l_suppkey, l_shipdate FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2)""")
def semi_join_repeated(spark, d):
    x = table(spark, d, "lineitem")
    many = x.groupBy("l_suppkey", "l_shipdate").count().filter("count > 2")
    return x.join(many, ["l_suppkey", "l_shipdate"], "left_semi").select("l_orderkey", "l_linenumber")


@query(f"WITH {TRIPS}, bad AS (SELECT DISTINCT ride_id FROM trips WHERE ride_duration > 400 AND ride_id IS NOT NULL) SELECT event_id FROM trips WHERE ride_id IS NULL OR ride_id NOT IN (SELECT ride_id FROM bad)")
def null_safe_anti(spark, d):
    t = trips(spark, d)
    return t.join(t.filter("ride_duration > 400").select("ride_id").distinct(), "ride_id", "left_anti").select("event_id")


@query(f"WITH {TRIPS} SELECT event_id, start_station_id IS NULL OR end_station_id IS NULL AS missing_station_id, coalesce(start_station_id = end_station_id, false) AS is_round_trip FROM trips")
def trip_flags(spark, d):
    return rules.with_flags(trips(spark, d)).select("event_id", "missing_station_id", "is_round_trip")


@query(f"""WITH {TRIPS} SELECT count(*) AS n_rows, count(DISTINCT ride_id) AS distinct_keys, count(ride_id) - count(DISTINCT ride_id) AS duplicate_rows, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS null_{c}' for c in ('ride_id', 'started_at', 'start_lat', 'start_station_id'))} FROM trips""")
def profile_nulls(spark, d):
    return quality.null_profile(trips(spark, d), ["ride_id", "started_at", "start_lat", "start_station_id"], "ride_id")


_Q = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}


@query("SELECT min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {v}), 6) AS {n}" for n, v in _Q.items()) + " FROM events")
def duration_quantiles(spark, d):
    return quality.quantiles(table(spark, d, "events"), "value", _Q)


@query(f"""WITH {TRIPS} SELECT round(min(start_lat), 6) AS lat_min, round(max(start_lat), 6) AS lat_max, round(min(start_lng), 6) AS lng_min, round(max(start_lng), 6) AS lng_max,
count(*) FILTER (WHERE NOT start_lat BETWEEN 40.55 AND 40.98 OR NOT start_lng BETWEEN -74.15 AND -73.72) AS outside FROM trips""")
def coordinate_ranges(spark, d):
    t = trips(spark, d)
    r = lambda f, c, n: F.round(f(c), 6).alias(n)
    return t.agg(r(F.min, "start_lat", "lat_min"), r(F.max, "start_lat", "lat_max"), r(F.min, "start_lng", "lng_min"), r(F.max, "start_lng", "lng_max"),
                 F.count_if(~F.col("start_lat").between(40.55, 40.98) | ~F.col("start_lng").between(-74.15, -73.72)).alias("outside"))


@query("""WITH p AS (SELECT strftime(ts, '%Y%m') AS month, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT month, CAST(sum(n) AS BIGINT) AS rides, count(*) AS days, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median FROM p GROUP BY 1""")
def rides_per_day(spark, d):
    p = table(spark, d, "events").groupBy(F.date_format("ts", "yyyyMM").alias("month"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return p.groupBy("month").agg(F.sum("n").alias("rides"), F.count("*").alias("days"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"))


@query("SELECT event_type, isodow(ts) >= 6 AS is_weekend, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1, 2, 3")
def category_mix(spark, d):
    g = table(spark, d, "events").groupBy("event_type", (F.extract(F.lit("dayofweek_iso"), "ts") >= 6).alias("is_weekend"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("event_type", "is_weekend", "hour", "n", F.round(100 * F.col("n") / F.col("t"), 4).alias("pct"))


@query(f"""WITH {TRIPS} SELECT event_type, count(*) AS n, count(start_station_id) AS with_start, count(*) FILTER (WHERE start_station_id IS NULL AND end_station_id IS NOT NULL) AS only_end, round(100.0::DOUBLE * count(start_station_id) / count(*), 4) AS pct FROM trips GROUP BY 1""")
def station_completeness(spark, d):
    t = trips(spark, d)
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.count("start_station_id").alias("with_start"), F.count_if(F.col("start_station_id").isNull() & F.col("end_station_id").isNotNull()).alias("only_end"), F.round(100 * F.count("start_station_id") / F.count("*"), 4).alias("pct"))


@query("""WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-09 00:00:00', TIMESTAMP '2024-01-11 23:00:00', INTERVAL 1 HOUR)) AS hour),
c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1) SELECT h.hour, coalesce(c.n, 0) AS n FROM h LEFT JOIN c ON h.hour = c.hour""")
def hour_profile(spark, d):
    h = spark.range(1).select(F.explode(timeutil.bins(datetime(2024, 1, 9), datetime(2024, 1, 12), 60)).alias("hour"))
    c = table(spark, d, "events").groupBy(timeutil.bin_start("ts", 60).alias("hour")).agg(F.count("*").alias("n"))
    return h.join(c, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {READINGS} SELECT status, count(*) AS n, round(avg(speed), 3) AS mean_speed, round(quantile_cont(speed, 0.5) FILTER (WHERE speed > 0 AND speed < 100), 6) AS median_speed, count(DISTINCT link_id) AS links, count(DISTINCT CAST(data_as_of AS DATE)) AS days FROM r GROUP BY 1""")
def traffic_profile(spark, d):
    r = readings(spark, d)
    good = F.when((F.col("speed") > 0) & (F.col("speed") < 100), F.col("speed"))
    return r.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("speed"), 3).alias("mean_speed"), F.round(F.percentile(good, 0.5), 6).alias("median_speed"), F.countDistinct("link_id").alias("links"), F.countDistinct(F.to_date("data_as_of")).alias("days"))


@query("""SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY)) AS d) x
WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def missing_days(spark, d):
    return quality.missing_days(table(spark, d, "orders"), "o_orderdate", date(1995, 1, 1), date(2001, 8, 1)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))



@query("""WITH e AS (SELECT user_id AS station_id, event_type AS name, ts, 40.55::DOUBLE + ((user_id * 37 + event_id % 7) % 450)::DOUBLE / 1000 AS lat, -74.15::DOUBLE + ((user_id * 53) % 450)::DOUBLE / 1000 AS lng, event_id % 2 = 1 AS is_pickup FROM events),
m AS (SELECT station_id, name, row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, name) AS i FROM e GROUP BY 1, 2),
a AS (SELECT station_id, count(DISTINCT name) AS n_distinct_names, median(lat) AS lat, median(lng) AS lng, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS appearances, count(*) FILTER (WHERE is_pickup) AS pickups, count(*) FILTER (WHERE NOT is_pickup) AS dropoffs,
count(DISTINCT CAST(ts AS DATE)) AS active_days, quantile_cont(lat, 0.01) AS y1, quantile_cont(lat, 0.99) AS y2, quantile_cont(lng, 0.01) AS x1, quantile_cont(lng, 0.99) AS x2 FROM e GROUP BY 1),
s AS (SELECT *, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))) AS km FROM a)
SELECT s.station_id, m.name AS station_name, n_distinct_names, round(lat, 6) AS lat, round(lng, 6) AS lng, first_seen, last_seen, appearances, pickups, dropoffs, active_days, round(km, 4) AS spread_km, km > 0.5 AS coord_anomaly FROM s JOIN m ON s.station_id = m.station_id AND m.i = 1""")
def station_registry(spark, d):
    from quadrille.operators import spatial

    u, i = F.col("user_id"), F.col("event_id")
    e = table(spark, d, "events").select(u.alias("station_id"), F.col("event_type").alias("name"), "ts", (40.55 + ((u * 37 + i % 7) % 450) / 1000).alias("lat"), (-74.15 + (u * 53 % 450) / 1000).alias("lng"), (i % 2 == 1).alias("is_pickup"))
    return spatial.station_registry(e).drop("lat_p01", "lat_p99", "lng_p01", "lng_p99").withColumns({c: F.round(c, 6) for c in ("lat", "lng")}).withColumn("spread_km", F.round("spread_km", 4))


@query("""SELECT event_id, ts, event_type, CAST(NULL AS BIGINT) AS conv_id FROM events UNION ALL SELECT NULL, NULL, role, conv_id FROM conversations""")
def union_by_name(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    c = table(spark, d, "conversations").select(F.col("role").alias("event_type"), "conv_id")
    return e.unionByName(c, allowMissingColumns=True)


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT event_type FROM events EXCEPT SELECT DISTINCT event_type FROM events WHERE value < 100) x) AS only_left,
(SELECT count(*) FROM (SELECT DISTINCT event_type FROM events WHERE value < 100 EXCEPT SELECT DISTINCT event_type FROM events) y) AS only_right""")
def set_equality(spark, d):
    e = table(spark, d, "events")
    a, b = e.select("event_type").distinct(), e.filter("value < 100").select("event_type").distinct()
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE ts < before) AS inversions FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events) x")
def sort_verifier(spark, d):
    return rules.sortedness(table(spark, d, "events"), "event_id", "ts")


@query(f"""WITH {READINGS} SELECT link_id, CAST(count(*) AS BIGINT) AS sample_rows, min(status) AS first_status, min(data_as_of) AS first_sampled_on, max(data_as_of) AS last_sampled_on FROM r GROUP BY 1""")
def link_registry(spark, d):
    r = readings(spark, d)
    return r.groupBy("link_id").agg(F.count("*").alias("sample_rows"), F.min("status").alias("first_status"), F.min("data_as_of").alias("first_sampled_on"), F.max("data_as_of").alias("last_sampled_on"))
