"""Queries written in Spark SQL over the engine's functions, with the same results as the DataFrame ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import sql
from quadrille.plans.context_queries import spans, stations
from quadrille.plans.registry import ORACLE_SQL, query, table


def _ready(spark, **views):
    sql.register(spark)
    for name, df in views.items():
        df.createOrReplaceTempView(f"quadrille_{name}")
    return spark


@query(ORACLE_SQL["link_cells"])
def link_cells_sql(spark, d):
    return _ready(spark, stations=stations(spark, d)).sql("""
        WITH l AS (SELECT id % 25 AS link_id, concat_ws(' ', array_sort(collect_list(concat(CAST(lat AS STRING), ',', CAST(lng AS STRING))))) AS line FROM quadrille_stations GROUP BY 1),
        v AS (SELECT link_id, polyline_points(line) AS points FROM l)
        SELECT DISTINCT link_id, cell_of(p.lat, p.lng, 0.05D) AS region_id FROM v LATERAL VIEW explode(points) x AS p""")


@query(ORACLE_SQL["ring_events"])
def ring_events_sql(spark, d):
    return _ready(spark, stations=stations(spark, d)).sql("""
        SELECT region_id, count_if(region_id = home) AS home, count_if(region_id <> home) AS ring
        FROM (SELECT home, cell_ring(home, 1) AS cells FROM (SELECT cell_of(lat, lng, 0.05D) AS home FROM quadrille_stations)) LATERAL VIEW explode(cells) r AS region_id GROUP BY region_id""")


@query(ORACLE_SQL["event_interval_bins"])
def event_interval_bins_sql(spark, d):
    return _ready(spark, spans=spans(spark, d)).sql("""
        WITH k AS (SELECT region_id, event_type, is_home, event_start, least(event_end, event_start + INTERVAL '24' HOUR) AS event_end FROM quadrille_spans), b AS (SELECT *, bins_between(event_start, event_end, 15) AS bins FROM k)
        SELECT region_id, ts, count_if(is_home) AS event_count, count_if(NOT is_home) AS event_count_ring, count(DISTINCT event_type) AS event_attendee_types,
               count_if(ts < event_start + INTERVAL '1' HOUR) AS event_started_recently, count_if(ts >= event_end - INTERVAL '1' HOUR) AS event_ending_soon
        FROM b LATERAL VIEW explode(bins) x AS ts GROUP BY region_id, ts""")


@query("""WITH b AS (SELECT DISTINCT event_type AS series, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS ts FROM events WHERE value > 90), n AS (SELECT series, ts, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS next FROM b)
SELECT series, ts + INTERVAL 15 MINUTE AS gap_start, next - INTERVAL 15 MINUTE AS gap_end, CAST(date_diff('minute', ts, next) // 15 - 1 AS INTEGER) AS missing FROM n WHERE next > ts + INTERVAL 15 MINUTE""")
def bin_gaps_sql(spark, d):
    """Stretches without a large value, of each kind of event: a table function over a partitioned and ordered table."""
    bins = table(spark, d, "events").filter("value > 90").select(F.col("event_type").alias("series"), "ts")
    return _ready(spark, large=bins).sql("""
        SELECT * FROM bin_gaps(TABLE(SELECT DISTINCT series, bin_of(ts, 15) AS ts FROM quadrille_large) PARTITION BY series ORDER BY (ts), 15)""")


@query("""SELECT event_id, ts - INTERVAL 5 HOUR AS local_ts, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS bin, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians((user_id % 90) - 10) / 2), 2) + cos(radians(10)) * cos(radians(user_id % 90)) * pow(sin(radians((user_id % 180) - 20) / 2), 2))), 6) AS km FROM events""")
def scalar_functions_sql(spark, d):
    return _ready(spark, events=table(spark, d, "events")).sql("""
        SELECT event_id, local_time(ts, 'America/New_York') AS local_ts, bin_of(ts, 15) AS bin, round(km_between(10D, 20D, CAST(user_id % 90 AS DOUBLE), CAST(user_id % 180 AS DOUBLE)), 6) AS km FROM quadrille_events""")
