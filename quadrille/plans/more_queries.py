"""Queries on registries, places in reach, rings of cells and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.operators import external, scan, spatial
from quadrille.operators import panel as P
from quadrille.plans.context_queries import KM, STATIONS, _WEATHER, sides, stations, weather
from quadrille.plans.panel_queries import PANEL, panel
from quadrille.plans.registry import ORACLE_SQL, query, table


@query("""WITH e AS (SELECT 40.55::DOUBLE + ((user_id * 37) % 450)::DOUBLE / 1000 AS lat, -74.15::DOUBLE + ((user_id * 53) % 450)::DOUBLE / 1000 AS lng FROM events
UNION SELECT 40.55::DOUBLE + ((event_id * 31) % 450)::DOUBLE / 1000, -74.15::DOUBLE + ((event_id * 29) % 450)::DOUBLE / 1000 FROM events) SELECT round(lat, 6) AS lat, round(lng, 6) AS lng FROM e""")
def distinct_coordinates(spark, d):
    """Start and end coordinates in one scan, once each."""
    u, i = F.col("user_id"), F.col("event_id")
    ends = F.array(F.struct((40.55 + (u * 37 % 450) / 1000).alias("lat"), (-74.15 + (u * 53 % 450) / 1000).alias("lng")), F.struct((40.55 + (i * 31 % 450) / 1000).alias("lat"), (-74.15 + (i * 29 % 450) / 1000).alias("lng")))
    return table(spark, d, "events").select(F.inline(ends)).distinct().select(F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("""WITH e AS (SELECT user_id AS station_id, event_id % 2 = 1 AS is_pickup FROM events UNION ALL SELECT event_id % 151, event_id % 2 = 0 FROM events) SELECT station_id, count(*) AS appearances, count(*) FILTER (WHERE is_pickup) AS pickups FROM e GROUP BY 1""")
def trip_endpoints(spark, d):
    """Both endpoints of every trip, exploded from one scan."""
    i = F.col("event_id")
    ends = F.array(F.struct(F.col("user_id").alias("station_id"), (i % 2 == 1).alias("is_pickup")), F.struct((i % 151).alias("station_id"), (i % 2 == 0).alias("is_pickup")))
    return table(spark, d, "events").select(F.inline(ends)).groupBy("station_id").agg(F.count("*").alias("appearances"), F.count_if("is_pickup").alias("pickups"))


@query("""SELECT lower(trim(p_type)) AS event_location, p_brand AS event_borough, count(*) AS n_event_rows FROM part GROUP BY 1, 2""")
def location_inventory(spark, d):
    return table(spark, d, "part").groupBy(F.lower(F.trim("p_type")).alias("event_location"), F.col("p_brand").alias("event_borough")).agg(F.count("*").alias("n_event_rows"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY 1""")
def status_rollup(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("status", "n", "urgent", F.round(100 * F.col("n") / F.col("t"), 4).alias("pct"))


_ROSTER = "SELECT s_suppkey * 2 AS station_id, s_name AS roster_name FROM supplier"


@query(f"""WITH s AS ({STATIONS}), r AS ({_ROSTER}) SELECT s.id AS station_id, r.roster_name, r.station_id IS NOT NULL AS in_roster_snapshot FROM s LEFT JOIN r ON s.id = r.station_id""")
def roster_join(spark, d):
    r = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("station_id"), F.col("s_name").alias("roster_name"), F.lit(True).alias("_in"))
    return stations(spark, d).select(F.col("id").alias("station_id")).join(r, "station_id", "left").select("station_id", "roster_name", F.coalesce("_in", F.lit(False)).alias("in_roster_snapshot"))


@query(f"""WITH s AS ({STATIONS}), e AS (SELECT event_id, ts AS event_start, ts + INTERVAL 6 HOUR AS event_end, 40.55::DOUBLE + ((event_id * 31) % 450)::DOUBLE / 1000 AS lat, -74.15::DOUBLE + ((event_id * 29) % 450)::DOUBLE / 1000 AS lng FROM events),
p AS (SELECT s.id AS station_id, e.event_id, {KM.format(a='s.lat', b='s.lng', c='e.lat', d='e.lng')} AS km FROM s, e WHERE e.event_start <= TIMESTAMP '2024-01-15 12:00:00' AND e.event_end >= TIMESTAMP '2024-01-15 12:00:00'),
k AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, event_id) AS rank FROM p WHERE km <= 8) SELECT station_id, event_id, rank, round(km, 6) AS km FROM k WHERE rank <= 3""")
def nearby_events(spark, d):
    """The nearest running events in reach of each station."""
    i = F.col("event_id")
    at = F.expr("timestamp_ntz'2024-01-15 12:00:00'")
    e = table(spark, d, "events").filter((F.col("ts") <= at) & (F.col("ts") + F.expr("interval 6 hours") >= at))
    e = e.select(i.alias("b_id"), (40.55 + (i * 31 % 450) / 1000).alias("b_lat"), (-74.15 + (i * 29 % 450) / 1000).alias("b_lng"))
    n = spatial.nearest(sides(stations(spark, d))[0], e, 3, 8.0)
    return n.select(F.col("a_id").alias("station_id"), F.col("b_id").alias("event_id"), "rank", F.round("km", 6).alias("km"))



@query(f"""WITH s AS ({STATIONS}), c AS (SELECT id, CAST(floor(lat / 0.05) AS BIGINT) AS r, CAST(floor(lng / 0.05) AS BIGINT) AS c FROM s),
x AS (SELECT id, CAST(r + i AS VARCHAR) || '_' || CAST(c + j AS VARCHAR) AS region_id, i = 0 AND j = 0 AS is_home FROM c, (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b)
SELECT region_id, count(*) FILTER (WHERE is_home) AS home, count(*) FILTER (WHERE NOT is_home) AS ring FROM x GROUP BY 1""")
def ring_events(spark, d):
    """Each point counts for its own cell and, apart, for the first ring around it."""
    g = spatial.SquareGrid(0.05)
    s = stations(spark, d).select(g.index(F.col("lat"), F.col("lng")).alias("home"))
    return s.select("home", F.explode(g.ring(F.col("home"))).alias("region_id")).groupBy("region_id").agg(F.count_if(F.col("region_id") == F.col("home")).alias("home"), F.count_if(F.col("region_id") != F.col("home")).alias("ring"))


@query(f"""WITH {_WEATHER} SELECT strftime(day, '%Y-%m-%d') AS day, round(temperature, 6) AS temperature, round(temperature - lag(temperature, 4) OVER o, 6) AS change4, round(temperature - lag(temperature, 12) OVER o, 6) AS change12 FROM w WINDOW o AS (ORDER BY day)""")
def weather_change(spark, d):
    w = W.orderBy("day")  # one row a day
    t = F.col("temperature")
    return weather(spark, d).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(t, 6).alias("temperature"), F.round(t - F.lag(t, 4).over(w), 6).alias("change4"), F.round(t - F.lag(t, 12).over(w), 6).alias("change12"))


@query(f"""WITH {PANEL}, f AS (SELECT region_id, ts, lag(pickups, 95) OVER w AS predicted FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)), g AS (SELECT region_id, ts, pickups, dropoffs FROM panel WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-22')
SELECT g.region_id, g.ts, g.pickups, f.predicted, CAST(date_diff('minute', TIMESTAMP '2024-01-20', g.ts) // 15 AS BIGINT) AS step FROM g JOIN f ON f.region_id = g.region_id AND f.ts = g.ts - INTERVAL 15 MINUTE""")
def forecast_grid(spark, d):
    """Forecasts beside what happened, by step and region."""
    p = panel(spark, d)
    f = p.select("region_id", (F.col("ts") + F.expr("interval 15 minutes")).alias("ts"), F.lag("pickups", 95).over(P.by_region()).alias("predicted"))
    g = p.filter("ts >= timestamp_ntz'2024-01-20' and ts < timestamp_ntz'2024-01-22'")
    step = F.floor(F.timestamp_diff("MINUTE", F.expr("timestamp_ntz'2024-01-20'"), F.col("ts")) / 15).cast("long")
    return g.join(f, ["region_id", "ts"]).select("region_id", "ts", "pickups", "predicted", step.alias("step"))


@query("""SELECT isodow(ts) >= 6 AS is_weekend, CAST(hour(ts) AS BIGINT) AS hour, round(count(*)::DOUBLE / count(DISTINCT CAST(ts AS DATE)), 6) AS rides_per_day FROM events GROUP BY 1, 2""")
def hourly_profile(spark, d):
    return table(spark, d, "events").groupBy((F.extract(F.lit("dayofweek_iso"), "ts") >= 6).alias("is_weekend"), F.hour("ts").cast("long").alias("hour")).agg(F.round(F.count("*") / F.countDistinct(F.to_date("ts")), 6).alias("rides_per_day"))


@query("""WITH w AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AS wet FROM orders GROUP BY 1), s AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT wet, count(*) AS days, round(avg(n), 6) AS rides, round(avg(q), 6) AS quantity FROM s JOIN w USING (day) GROUP BY 1""")
def wet_and_dry_days(spark, d):
    w = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.count_if(F.col("o_orderstatus") == "P") > 0).alias("wet"))
    s = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    return s.join(w, "day").groupBy("wet").agg(F.count("*").alias("days"), F.round(F.avg("n"), 6).alias("rides"), F.round(F.avg("q"), 6).alias("quantity"))


@query(f"""WITH s AS ({STATIONS}) SELECT round(min(lat) - 1.5::DOUBLE / (6371.0088 * pi() / 180), 6) AS south, round(max(lat) + 1.5::DOUBLE / (6371.0088 * pi() / 180), 6) AS north,
round(min(lng) - 1.5::DOUBLE / (6371.0088 * pi() / 180) / cos(radians((min(lat) + max(lat)) / 2)), 6) AS west, round(max(lng) + 1.5::DOUBLE / (6371.0088 * pi() / 180) / cos(radians((min(lat) + max(lat)) / 2)), 6) AS east FROM s""")
def padded_bounds(spark, d):
    b = stations(spark, d).agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lng").alias("c"), F.max("lng").alias("e"))
    y = 1.5 / spatial.KM_PER_DEGREE
    x = y / F.cos(F.radians((F.col("a") + F.col("b")) / 2))
    return b.select(F.round(F.col("a") - y, 6).alias("south"), F.round(F.col("b") + y, 6).alias("north"), F.round(F.col("c") - x, 6).alias("west"), F.round(F.col("e") + x, 6).alias("east"))


@query(f"""WITH {PANEL}, n AS (SELECT region_id, ts, CASE WHEN pickups > 0 THEN dropoffs::DOUBLE / pickups END AS ratio, least(greatest(pickups - dropoffs, -2), 2) AS clipped FROM panel) SELECT region_id, ts, round(ratio, 6) AS ratio, clipped FROM n""")
def safe_ratio(spark, d):
    return panel(spark, d).select("region_id", "ts", F.round(F.col("dropoffs") / F.nullif("pickups", F.lit(0)), 6).alias("ratio"), F.least(F.greatest(F.col("pickups") - F.col("dropoffs"), F.lit(-2)), F.lit(2)).alias("clipped"))


_MEANS = ", ".join(f"round(sum(b.pickups * pow({n - 1}::DOUBLE / {n + 1}, a.i - b.i)) / sum(pow({n - 1}::DOUBLE / {n + 1}, a.i - b.i)), 6) AS pickups_ewm{n}" for n in (4, 96))


@query(f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ts) AS i FROM panel) SELECT a.region_id, a.ts, {_MEANS} FROM n a JOIN n b ON a.region_id = b.region_id AND b.i <= a.i GROUP BY 1, 2""")
def exact_long_means(spark, d):
    """Exponentially weighted means of an hour's and a day's span over whole histories."""
    return scan.ewm_means(panel(spark, d), ["pickups"], [4, 96], chunk="day").select("region_id", "ts", *(F.round(c, 6).alias(c) for c in ("pickups_ewm4", "pickups_ewm96")))


@query(f"""WITH {PANEL}, s AS (SELECT region_id, avg(pickups) AS mean, stddev_pop(pickups) AS std FROM panel WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1)
SELECT ts, list_aggregate(list_transform(list(round((pickups - mean) / nullif(std, 0), 4) ORDER BY region_id), lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), 'string_agg', ',') AS demand FROM panel JOIN s USING (region_id) GROUP BY 1""")
def tensor_rows(spark, d):
    """The scaled time-by-region tensor, a row a time; values as thousandths."""
    from quadrille.sources import sinks

    p = panel(spark, d)
    s = p.filter("ts < timestamp_ntz'2024-01-21'").groupBy("region_id").agg(F.avg("pickups").alias("mean"), F.stddev_pop("pickups").alias("std"))
    return sinks.tensor_long(p, s).select("ts", F.concat_ws(",", F.transform("demand", lambda x: F.round(F.round(x, 4) * 1000).cast("long").cast("string"))).alias("demand"))


@query("SELECT event_id, user_id, ts, value FROM events")
def paged_events(spark, d):
    """All events through a source that answers by windows of time: two days a partition, windows halved until no page is full."""
    from datetime import timedelta

    from quadrille.sources import paged

    lo, hi = table(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    end = hi.replace(microsecond=0) + timedelta(seconds=1)
    path = paged.in_time_order(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "ts")
    rows = paged.register(spark).read.format("paged").schema("event_id long, user_id long, ts timestamp_ntz, value double")
    return rows.options(transport="quadrille.sources.paged:ordered", path=path, time="ts", start=lo.replace(microsecond=0).isoformat(), end=end.isoformat(), window_hours=48, page_rows=1000).load()


@query(ORACLE_SQL["tensor_rows"])
def tensor_bundle(spark, d):
    """The scaled time-by-region tensor written as a bundle of numpy shards and read back from them."""
    from quadrille.sources import bundle, sinks
    from quadrille.storage import new_path

    p = panel(spark, d)
    s = p.filter("ts < timestamp_ntz'2024-01-21'").groupBy("region_id").agg(F.avg("pickups").alias("mean"), F.stddev_pop("pickups").alias("std"))
    path = new_path(spark, "bundle")
    rows = sinks.tensor_long(p, s)
    bundle.write_bundle(rows.select("ts", F.transform("demand", lambda x: F.coalesce(x, F.lit(0.0))).alias("demand")).repartitionByRange(8, "ts").sortWithinPartitions("ts"), path, {"scaling_fitted_on": "train"}, shard_rows=500)
    back = bundle.read_bundle(spark, path)
    return back.select(F.timestamp_micros("ts").cast("timestamp_ntz").alias("ts"), F.concat_ws(",", F.transform("demand", lambda x: F.round(F.round(x, 4) * 1000).cast("long").cast("string"))).alias("demand"))
