"""Queries that join context to the panel, and spatial joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quadrille.functions import timeutil
from quadrille.operators import external, nearest, spatial
from quadrille.plans.panel_queries import PANEL, panel
from quadrille.plans.registry import query, table

SPANS = """spans AS (SELECT event_type AS region_id, props AS kind, ts AS event_start, ts + CAST(floor(value) AS BIGINT) * INTERVAL 10 MINUTE AS event_end, event_id % 3 > 0 AS is_home FROM events)"""


def spans(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("region_id"), F.col("props").alias("event_type"), F.col("ts").alias("event_start"), (F.col("ts") + F.make_dt_interval(mins=(F.floor("value") * 10).cast("int"))).alias("event_end"), (F.col("event_id") % 3 > 0).alias("is_home"))


@query(f"""WITH {SPANS}, k AS (SELECT region_id, kind, is_home, event_start, CASE WHEN event_end > event_start + INTERVAL 24 HOUR THEN event_start + INTERVAL 24 HOUR ELSE event_end END AS event_end FROM spans),
b AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, event_start), time_bucket(INTERVAL 15 MINUTE, event_end), INTERVAL 15 MINUTE)) AS ts FROM k)
SELECT region_id, ts, count(*) FILTER (WHERE is_home) AS event_count, count(*) FILTER (WHERE NOT is_home) AS event_count_ring, count(DISTINCT kind) AS event_attendee_types,
count(*) FILTER (WHERE ts < event_start + INTERVAL 1 HOUR) AS event_started_recently, count(*) FILTER (WHERE ts >= event_end - INTERVAL 1 HOUR) AS event_ending_soon FROM b GROUP BY 1, 2""")
def event_interval_bins(spark, d):
    return external.event_bins(spans(spark, d))



@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-03-31' AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1997-03-01'")
def interval_overlap(spark, d):
    o = table(spark, d, "orders")
    return o.filter((F.col("o_orderdate") <= F.lit(datetime(1997, 3, 31)).cast("timestamp_ntz")) & (F.col("o_orderdate") + F.expr("interval 30 days") >= F.lit(datetime(1997, 3, 1)).cast("timestamp_ntz"))).select("o_orderkey")


_LINKS = "SELECT CAST(l_suppkey % 8 AS VARCHAR) AS region_id, time_bucket(INTERVAL 7 DAY, l_shipdate, TIMESTAMP '1995-01-02') AS ts, l_suppkey AS link_id, l_quantity AS speed, l_extendedprice AS travel_time, l_shipdate FROM lineitem"


def link_readings(spark, d):
    x = table(spark, d, "lineitem")
    return x.select((F.col("l_suppkey") % 8).cast("string").alias("region_id"), F.window("l_shipdate", "7 days", startTime="4 days")["start"].alias("ts"), F.col("l_suppkey").alias("link_id"), F.col("l_quantity").alias("speed"), F.col("l_extendedprice").alias("travel_time"), "l_shipdate")


_TRAFFIC = f"""r AS ({_LINKS}), f AS (SELECT link_id, quantile_cont(speed, 0.85) AS free_speed, quantile_cont(travel_time, 0.15) AS free_time FROM r WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1),
m AS (SELECT region_id, ts, link_id, avg(speed) AS speed, avg(travel_time) AS travel_time FROM r GROUP BY 1, 2, 3),
b AS (SELECT region_id, ts, avg(speed) AS traffic_speed_mean, min(speed) AS traffic_speed_min, count(DISTINCT m.link_id) AS traffic_link_count, avg(speed / nullif(free_speed, 0)) AS congestion_index, avg(travel_time / nullif(free_time, 0)) AS travel_time_index FROM m LEFT JOIN f USING (link_id) GROUP BY 1, 2)"""


@query(f"WITH {_TRAFFIC} SELECT region_id, ts, round(traffic_speed_mean, 6) AS traffic_speed_mean, round(traffic_speed_min, 6) AS traffic_speed_min, traffic_link_count, round(congestion_index, 6) AS congestion_index, round(travel_time_index, 6) AS travel_time_index FROM b")
def two_stage_mean(spark, d):
    r = link_readings(spark, d)
    t = external.traffic_bins(r, external.free_flow(r.filter("l_shipdate < timestamp_ntz'1999-01-01'")))
    return t.withColumns({c: F.round(c, 6) for c in ("traffic_speed_mean", "traffic_speed_min", "congestion_index", "travel_time_index")})


@query(f"""WITH {_TRAFFIC} SELECT region_id, ts, round(traffic_speed_mean - lag(traffic_speed_mean) OVER w, 6) AS row_change,
CASE WHEN lag(ts) OVER w = ts - INTERVAL 7 DAY THEN round(traffic_speed_mean - lag(traffic_speed_mean) OVER w, 6) END AS timed_change FROM b WHERE traffic_link_count > 6 WINDOW w AS (PARTITION BY region_id ORDER BY ts)""")
def traffic_change(spark, d):
    r = link_readings(spark, d)
    t = external.traffic_bins(r, external.free_flow(r.filter("l_shipdate < timestamp_ntz'1999-01-01'"))).filter("traffic_link_count > 6")
    return t.select("region_id", "ts", F.round(external.change("traffic_speed_mean"), 6).alias("row_change"), F.round(external.change("traffic_speed_mean", minutes=7 * 1440), 6).alias("timed_change"))


@query(f"WITH r AS ({_LINKS}) SELECT link_id, round(quantile_cont(speed, 0.85), 6) AS free_speed, round(quantile_cont(travel_time, 0.15), 6) AS free_time FROM r WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1")
def free_flow_reference(spark, d):
    r = link_readings(spark, d)
    return external.free_flow(r.filter("l_shipdate < timestamp_ntz'1999-01-01'")).withColumns({c: F.round(c, 6) for c in ("free_speed", "free_time")})


_EDGES = [("click", "view"), ("view", "click"), ("click", "error"), ("error", "click"), ("purchase", "view"), ("view", "purchase"), ("signup", "error"), ("error", "signup")]


@query(f"""WITH {PANEL}, e(region_id, neighbor_id) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _EDGES)}), n AS (SELECT e.region_id, p.ts, CAST(sum(p.pickups) AS BIGINT) AS neighbor_sum, avg(p.pickups) AS neighbor_mean, max(p.pickups) AS neighbor_max, count(*) AS neighbor_count
FROM e JOIN panel p ON p.region_id = e.neighbor_id GROUP BY 1, 2) SELECT n.region_id, n.ts, neighbor_sum, round(neighbor_mean, 6) AS neighbor_mean, neighbor_max, neighbor_count, round(p.pickups - neighbor_mean, 6) AS gradient FROM n JOIN panel p ON p.region_id = n.region_id AND p.ts = n.ts""")
def adjacency_agg(spark, d):
    p = panel(spark, d)
    n = external.neighbour_stats(p, spark.createDataFrame(_EDGES, "region_id string, neighbor_id string"), "pickups")
    return n.join(p, ["region_id", "ts"]).select("region_id", "ts", "neighbor_sum", F.round("neighbor_mean", 6).alias("neighbor_mean"), "neighbor_max", "neighbor_count", F.round(F.col("pickups") - F.col("neighbor_mean"), 6).alias("gradient"))


@query("""WITH s AS (SELECT user_id AS station_id, any_value(CAST(user_id % 16 AS VARCHAR)) AS region_id, min(ts) AS first_seen, count(*) AS appearances FROM events GROUP BY 1),
g AS (SELECT region_id, month FROM (SELECT DISTINCT region_id FROM s) x, (SELECT unnest(['202312', '202401', '202402']) AS month) y)
SELECT g.region_id, g.month, count(s.station_id) AS active_station_count, count(s.station_id) / 2.5::DOUBLE AS station_density_km2, CAST(coalesce(sum(s.appearances), 0) AS BIGINT) AS region_hist_trip_volume
FROM g LEFT JOIN s ON g.region_id = s.region_id AND strftime(s.first_seen, '%Y%m') <= g.month GROUP BY 1, 2""")
def theta_month_join(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("station_id"), (F.col("user_id") % 16).cast("string").alias("region_id")).agg(F.min("ts").alias("first_seen"), F.count("*").alias("appearances"))
    g = s.select("region_id").distinct().select("region_id", F.explode(F.array(*map(F.lit, ("202312", "202401", "202402")))).alias("month"), F.lit(2.5).alias("area_km2"))
    return external.station_network(g, s)



_WEATHER = """w AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(round(sum(o_totalprice) * 100) AS BIGINT) // count(*) / 1000000.0::DOUBLE - 10 AS temperature, count(*) FILTER (WHERE o_orderstatus = 'F') / 20.0::DOUBLE AS rain, count(*) FILTER (WHERE o_orderstatus = 'P') / 4.0::DOUBLE AS snow, max(o_totalprice) / 10000 AS wind FROM orders GROUP BY 1)"""


def weather(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg((F.floor(F.round(F.sum("o_totalprice") * 100).cast("long") / F.count("*")) / 1000000 - 10).alias("temperature"), (F.count_if(F.col("o_orderstatus") == "F") / 20).alias("rain"), (F.count_if(F.col("o_orderstatus") == "P") / 4).alias("snow"), (F.max("o_totalprice") / 10000).alias("wind"))


@query(f"WITH {_WEATHER} SELECT l_orderkey, l_linenumber, round(temperature, 6) AS temperature, rain > 0.1 AS is_rain, snow > 0.1 AS is_snow, temperature < 0 AS is_freezing, wind > 30 AS is_windy FROM lineitem LEFT JOIN w ON CAST(l_shipdate + INTERVAL 15 MINUTE AS DATE) = w.day")
def weather_join(spark, d):
    x = table(spark, d, "lineitem").withColumn("day", F.to_date(F.col("l_shipdate") + F.expr("interval 15 minutes")))
    return x.join(weather(spark, d), "day", "left").select("l_orderkey", "l_linenumber", F.round("temperature", 6).alias("temperature"), *(c.alias(n) for n, c in external.weather_flags().items()))


# readings arrive seven minutes after they were made, so that no row has its own
_READ = "SELECT ts + INTERVAL 7 MINUTE AS ts, max(value) AS reading FROM events GROUP BY 1"


@query(f"WITH r AS ({_READ}) SELECT e.event_id, e.ts, r.reading FROM events e ASOF LEFT JOIN r ON e.ts >= r.ts")
def asof_weather(spark, d):
    e = table(spark, d, "events")
    r = e.groupBy((F.col("ts") + F.expr("interval 7 minutes")).alias("ts")).agg(F.max("value").alias("reading"))
    return external.as_of_buckets(e.select("event_id", "ts"), r, "ts", "reading")



@query("WITH r AS (SELECT event_type, ts + INTERVAL 7 MINUTE AS ts, max(value) AS reading FROM events GROUP BY 1, 2) SELECT e.event_id, e.event_type, e.ts, r.reading FROM events e ASOF LEFT JOIN r ON e.event_type = r.event_type AND e.ts >= r.ts")
def asof_by_key(spark, d):
    e = table(spark, d, "events")
    r = e.groupBy("event_type", (F.col("ts") + F.expr("interval 7 minutes")).alias("ts")).agg(F.max("value").alias("reading"))
    return external.as_of(e.select("event_id", "event_type", "ts"), r, ["event_type"], "ts", "reading")



@query("""SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END AS k FROM nation) a JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_join(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("left_key"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("k"))
    b = n.select(F.col("n_nationkey").alias("right_key"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("k2"))
    return a.join(b, F.col("k").eqNullSafe(F.col("k2"))).select("left_key", "right_key")


STATIONS = "SELECT DISTINCT user_id AS id, 40.55::DOUBLE + ((user_id * 37) % 450)::DOUBLE / 1000 AS lat, -74.15::DOUBLE + ((user_id * 53) % 450)::DOUBLE / 1000 AS lng FROM events"
KM = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def stations(spark, d):
    u = F.col("user_id")
    return table(spark, d, "events").select(u.alias("id"), (40.55 + (u * 37 % 450) / 1000).alias("lat"), (-74.15 + (u * 53 % 450) / 1000).alias("lng")).distinct()


def sides(s):
    return s.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng")), s.select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))


_PAIRS = f"s AS ({STATIONS}), p AS (SELECT a.id AS a_id, b.id AS b_id, {KM.format(a='a.lat', b='a.lng', c='b.lat', d='b.lng')} AS km FROM s a, s b)"


@query(f"WITH {_PAIRS} SELECT a_id, b_id, round(km, 6) AS km FROM p WHERE km <= 5 AND a_id <> b_id")
def radius_join(spark, d):
    a, b = sides(stations(spark, d))
    return spatial.within(a, b, 5.0).filter("a_id <> b_id").select("a_id", "b_id", F.round("km", 6).alias("km"))


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY km, b_id) AS rank FROM p WHERE km <= 12) SELECT a_id, b_id, rank, round(km, 6) AS km FROM r WHERE rank <= 4")
def haversine_knn(spark, d):
    a, b = sides(stations(spark, d))
    return spatial.nearest(a, b, 4, 12.0).select("a_id", "b_id", "rank", F.round("km", 6).alias("km"))


@query(f"""WITH s AS ({STATIONS}), c AS (SELECT c_custkey AS id, -85::DOUBLE + (c_custkey * 7919 % 17000)::DOUBLE / 100 AS lat, -180::DOUBLE + (c_custkey * 104729 % 36000)::DOUBLE / 100 AS lng FROM customer),
p AS (SELECT c.id AS point, s.id AS station, {KM.format(a='c.lat', b='c.lng', c='s.lat', d='s.lng')} AS km FROM c, s), r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, station) AS rank FROM p)
SELECT point, station, CAST(rank AS INTEGER) AS rank, round(km, 5) AS km FROM r WHERE rank <= 5""")
def knn_exact(spark, d):
    """The five stations nearest to each customer, wherever on the globe."""
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("id"), (-85 + k * 7919 % 17000 / 100).alias("lat"), (-180 + k * 104729 % 36000 / 100).alias("lng"))
    return nearest.k_nearest(points, stations(spark, d), 5, 32).select(F.col("id").alias("point"), F.col("other").alias("station"), "rank", F.round("km", 5).alias("km"))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY km, b_id) AS n FROM p WHERE km <= 4 AND a_id <> b_id), e AS (SELECT a_id AS u, b_id AS v, km FROM r WHERE n <= 3 UNION SELECT b_id, a_id, km FROM r WHERE n <= 3)
SELECT u, v, round(min(km), 6) AS km FROM e GROUP BY 1, 2""")
def station_graph(spark, d):
    return spatial.station_graph(stations(spark, d), 3, 4.0).withColumn("km", F.round("km", 6))


@query(f"WITH s AS ({STATIONS}), c AS (SELECT id % 12 AS region, avg(lat) AS lat, avg(lng) AS lng FROM s GROUP BY 1) SELECT a.region AS a, b.region AS b, round({KM.format(a='a.lat', b='a.lng', c='b.lat', d='b.lng')}, 4) AS km FROM c a, c b")
def distance_matrix(spark, d):
    c = stations(spark, d).groupBy((F.col("id") % 12).alias("a")).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    o = F.broadcast(c.select(F.col("a").alias("b"), F.col("lat").alias("y"), F.col("lng").alias("x")))  # a fixed number of regions
    return c.crossJoin(o).select("a", "b", F.round(spatial.haversine_km("lat", "lng", "y", "x"), 4).alias("km"))


_CELL = "CAST(CAST(floor({lat} / 0.05) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor({lng} / 0.05) AS BIGINT) AS VARCHAR)"


@query(f"""WITH e AS (SELECT event_id, 40.55::DOUBLE + ((user_id * 37) % 450)::DOUBLE / 1000 AS lat, -74.15::DOUBLE + ((user_id * 53) % 450)::DOUBLE / 1000 AS lng FROM events) SELECT event_id, {_CELL.format(lat='lat', lng='lng')} AS region_id FROM e""")
def coord_lookup_join(spark, d):
    u = F.col("user_id")
    e = table(spark, d, "events").select("event_id", (40.55 + (u * 37 % 450) / 1000).alias("lat"), (-74.15 + (u * 53 % 450) / 1000).alias("lng"))
    return spatial.index_points(e, spatial.SquareGrid(0.05)).select("event_id", "region_id")


@query(f"""WITH s AS ({STATIONS}), c AS (SELECT floor(lat / 0.05) AS r, floor(lng / 0.05) AS c, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT DISTINCT r, c FROM c)
SELECT CAST(CAST(a.r AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(a.c AS BIGINT) AS VARCHAR) AS region_id, a.n AS station_count, round((a.r + 0.5) * 0.05, 6) AS centroid_lat, round((a.c + 0.5) * 0.05, 6) AS centroid_lng,
round(pow(0.05::DOUBLE * 6371.0088 * pi() / 180, 2) * cos(radians((a.r + 0.5) * 0.05)), 6) AS area_km2, (SELECT count(*) FROM k WHERE abs(k.r - a.r) <= 1 AND abs(k.c - a.c) <= 1) - 1 AS n_neighbors FROM c a""")
def region_metadata(spark, d):
    g = spatial.SquareGrid(0.05)
    s = stations(spark, d).withColumn("region_id", g.index(F.col("lat"), F.col("lng"))).groupBy("region_id").agg(F.count("*").alias("station_count"))
    ring = s.select("region_id", F.explode(g.ring(F.col("region_id"))).alias("cell"))
    near = ring.join(s.select(F.col("region_id").alias("cell")), "cell").groupBy("region_id").agg((F.count("*") - 1).alias("n_neighbors"))
    lat, lng = g.centroid(F.col("region_id"))
    return s.join(near, "region_id").select("region_id", "station_count", F.round(lat, 6).alias("centroid_lat"), F.round(lng, 6).alias("centroid_lng"), F.round(g.area_km2(F.col("region_id")), 6).alias("area_km2"), "n_neighbors")


# the stations lie on face 4; the curve is followed bit by bit: where a quarter stands under each turn, and how it turns the next
_TOKENS = f"""x AS (SELECT *, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y, sin(radians(lat)) AS z FROM s), t AS (SELECT id, -1 * x / y AS q, z / y AS p FROM x),
f AS (SELECT id, CAST(floor((CASE WHEN p >= 0 THEN 0.5 * sqrt(1 + 3 * p) ELSE 1 - 0.5 * sqrt(1 - 3 * p) END) * 8192) AS BIGINT) AS i, CAST(floor((CASE WHEN q >= 0 THEN 0.5 * sqrt(1 + 3 * q) ELSE 1 - 0.5 * sqrt(1 - 3 * q) END) * 8192) AS BIGINT) AS j FROM t),
r AS (SELECT id, i, j, 12 AS k, 0::BIGINT AS pos, 0 AS turn FROM f UNION ALL SELECT id, i, j, k - 1, pos * 4 + place, xor(turn, [1, 0, 0, 3][place + 1]) FROM (SELECT *, [[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]][turn + 1][1 + (i >> k & 1) * 2 + (j >> k & 1)] AS place FROM r WHERE k >= 0) y)"""


@query(f"""WITH RECURSIVE s AS ({STATIONS}), {_TOKENS} SELECT r.id, '4/' || CAST(f.i AS VARCHAR) || '/' || CAST(f.j AS VARCHAR) AS cell, rtrim(printf('%016x', (4::UBIGINT << 61) | ((pos::UBIGINT * 2 + 1) << 34)), '0') AS token FROM r JOIN f ON r.id = f.id WHERE k = -1""")
def s2_cells(spark, d):
    g = spatial.S2Grid(13)
    return stations(spark, d).select("id", g.face_name(F.col("lat"), F.col("lng")).alias("cell"), g.index(F.col("lat"), F.col("lng")).alias("token"))


@query(f"""WITH s AS ({STATIONS}), p AS (SELECT *, (SELECT sqrt(4 * pi() * 6371.0088 * 6371.0088 / (2 + 120 * pow(7, 8)) * 2 / (3 * sqrt(3)))) AS size, radians(lng) * 6371.0088 * cos(radians(40.7)) AS x, sin(radians(lat)) * 6371.0088 / cos(radians(40.7)) AS y FROM s),
c AS (SELECT DISTINCT i.id, i.lat, i.lng, i.size, i.x, i.y, CAST(round(i.x / (i.size * sqrt(3)) - round(i.y / (1.5::DOUBLE * i.size)) / 2) + a AS BIGINT) AS q, CAST(round(i.y / (1.5::DOUBLE * i.size)) + b AS BIGINT) AS r FROM p i, (SELECT unnest([-1, 0, 1]) AS a) u, (SELECT unnest([-1, 0, 1]) AS b) v),
n AS (SELECT id, lat, lng, q, r, row_number() OVER (PARTITION BY id ORDER BY pow(x - size * sqrt(3) * (q + r / 2), 2) + pow(y - size * 1.5::DOUBLE * r, 2)) AS nth FROM c), k AS (SELECT q, r, count(*) AS stations FROM n WHERE nth = 1 GROUP BY 1, 2),
e AS (SELECT k.*, o.q AS near FROM k LEFT JOIN k o ON (o.q, o.r) IN ((k.q + 1, k.r), (k.q - 1, k.r), (k.q, k.r + 1), (k.q, k.r - 1), (k.q + 1, k.r - 1), (k.q - 1, k.r + 1))), z AS (SELECT q, r, stations, count(near) AS n_neighbors FROM e GROUP BY 1, 2, 3), y AS (SELECT any_value(size) AS size FROM p)
SELECT 'h8_' || CAST(q AS VARCHAR) || '_' || CAST(r AS VARCHAR) AS region_id, stations, n_neighbors, round(degrees(asin(size * 1.5::DOUBLE * r * cos(radians(40.7)) / 6371.0088)), 6) AS centroid_lat, round(degrees(size * sqrt(3) * (q + r / 2) / 6371.0088 / cos(radians(40.7))), 6) AS centroid_lng, round(1.5::DOUBLE * sqrt(3) * size * size, 6) AS area_km2 FROM z, y""")
def hex_regions(spark, d):
    """Hexagonal cells with stations: index, first ring, centroid, area.  The SQL takes the nearest of nine centres."""
    g = spatial.HexGrid(8)
    s = stations(spark, d).groupBy(g.index(F.col("lat"), F.col("lng")).alias("region_id")).agg(F.count("*").alias("stations"))
    ring = s.select("region_id", F.explode(g.ring(F.col("region_id"))).alias("cell"))
    near = ring.join(s.select(F.col("region_id").alias("cell")), "cell").groupBy("region_id").agg((F.count("*") - 1).alias("n_neighbors"))
    lat, lng = g.centroid(F.col("region_id"))
    return s.join(near, "region_id").select("region_id", "stations", "n_neighbors", F.round(lat, 6).alias("centroid_lat"), F.round(lng, 6).alias("centroid_lng"), F.round(g.area_km2(F.col("region_id")), 6).alias("area_km2"))


@query("WITH v(system, resolution, area, cells) AS (VALUES ('s2', 12, 5.06638::DOUBLE, 110), ('s2', 13, 1.26659::DOUBLE, 231), ('s2', 14, 0.31665::DOUBLE, 690)) SELECT system, resolution, round(0.7::DOUBLE * abs(ln(area / 0.7372)) + 0.3::DOUBLE * abs(ln(cells / 321.0)), 6) AS score FROM v")
def grid_matching(spark, d):
    """How far each level is from a reference grid, by area and by the number of cells."""
    v = spark.createDataFrame([("s2", 12, 5.06638, 110), ("s2", 13, 1.26659, 231), ("s2", 14, 0.31665, 690)], "system string, resolution int, area double, cells int")
    return v.select("system", "resolution", F.round(0.7 * F.abs(F.ln(F.col("area") / 0.7372)) + 0.3 * F.abs(F.ln(F.col("cells") / 321.0)), 6).alias("score"))
