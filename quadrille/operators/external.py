"""Context joined to the panel: events over bins, traffic in two stages, weather, neighbours, station counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.functions import timeutil


def event_bins(events: DataFrame, minutes: int = 15, cap_hours: int = 24, fresh_minutes: int = 60) -> DataFrame:
    """Per (region_id, ts) over the bins of events(region_id, event_type, event_start, event_end, is_home), which last `cap_hours` at most.

    Home and ring events are counted apart; types, and events that began or end within `fresh_minutes`, over both."""
    last = F.least("event_end", F.col("event_start") + F.expr(f"interval {cap_hours} hours"))
    spread = events.withColumn("event_end", last).withColumn("ts", F.explode(timeutil.interval_bins(F.col("event_start"), F.col("event_end"), minutes, cap_hours)))
    near = F.expr(f"interval {fresh_minutes} minutes")
    return spread.groupBy("region_id", "ts").agg(
        F.count_if("is_home").alias("event_count"), F.count_if(~F.col("is_home")).alias("event_count_ring"), F.countDistinct("event_type").alias("event_attendee_types"),
        F.count_if(F.col("ts") < F.col("event_start") + near).alias("event_started_recently"), F.count_if(F.col("ts") >= F.col("event_end") - near).alias("event_ending_soon"))


def link_means(readings: DataFrame) -> DataFrame:
    """First stage: the mean of each link in each (region_id, ts)."""
    return readings.groupBy("region_id", "ts", "link_id").agg(F.avg("speed").alias("speed"), F.avg("travel_time").alias("travel_time"))


def free_flow(train: DataFrame) -> DataFrame:
    """Reference of each link from training readings: the 85th percentile of speed, the 15th of travel time."""
    return train.groupBy("link_id").agg(F.percentile("speed", 0.85).alias("free_speed"), F.percentile("travel_time", 0.15).alias("free_time"))


def traffic_bins(readings: DataFrame, reference: DataFrame) -> DataFrame:
    """Second stage: over links, so that a link with many readings doesn't outweigh the others."""
    m = link_means(readings).join(reference, "link_id", "left")
    return m.groupBy("region_id", "ts").agg(
        F.avg("speed").alias("traffic_speed_mean"), F.min("speed").alias("traffic_speed_min"), F.countDistinct("link_id").alias("traffic_link_count"),
        F.avg(F.col("speed") / F.nullif("free_speed", F.lit(0.0))).alias("congestion_index"), F.avg(F.col("travel_time") / F.nullif("free_time", F.lit(0.0))).alias("travel_time_index"))


def change(name: str, by: str = "region_id", ts: str = "ts", minutes: int | None = None) -> Column:
    """Difference from the row before; with `minutes`, null unless that row is exactly so much earlier."""
    w = W.partitionBy(by).orderBy(ts)
    diff = F.col(name) - F.lag(name).over(w)
    if minutes is None:
        return diff
    return F.when(F.lag(ts).over(w) == F.col(ts) - F.expr(f"interval {minutes} minutes"), diff)


def neighbour_stats(panel: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Sum, mean, largest and number of the neighbours' values, over edges(region_id, neighbor_id)."""
    n = panel.select(F.col("region_id").alias("neighbor_id"), "ts", F.col(name).alias("_v"))
    return edges.join(n, "neighbor_id").groupBy("region_id", "ts").agg(F.sum("_v").alias("neighbor_sum"), F.avg("_v").alias("neighbor_mean"), F.max("_v").alias("neighbor_max"), F.count("*").alias("neighbor_count"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: a union and one window, no range join."""
    keys = [*by, ts]
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = [ts, "_side"]
    w = (W.partitionBy(*by) if by else W).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_value")


def as_of_buckets(left: DataFrame, right: DataFrame, ts: str, value: str, bucket: str = "day") -> DataFrame:
    """As-of join without a key, split by time: within a bucket by window, and the last value of earlier buckets for its start."""
    cut = lambda d: d.withColumn("_b", F.date_trunc(bucket, ts).cast("timestamp_ntz"))
    l, r = cut(left), cut(right.select(ts, value))
    last = r.groupBy("_b").agg(F.max_by(value, ts).alias("_carry"))
    spine = l.select("_b").union(r.select("_b")).distinct().join(last, "_b", "left").withColumn("_carry", F.last("_carry", ignorenulls=True).over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    inside = as_of(l, r, ["_b"], ts, value)
    return inside.join(spine, "_b", "left").withColumn(value, F.coalesce(value, "_carry")).drop("_b", "_carry")


def weather_flags(temp: str = "temperature", rain: str = "rain", snow: str = "snow", wind: str = "wind") -> dict[str, Column]:
    return {"is_rain": F.col(rain) > 0.1, "is_snow": F.col(snow) > 0.1, "is_freezing": F.col(temp) < 0, "is_windy": F.col(wind) > 30}


def station_network(regions_months: DataFrame, stations: DataFrame, strict: bool = False) -> DataFrame:
    """Per (region_id, month): stations first seen by that month, density and their appearances.

    strict counts a station from the month after it was first seen only."""
    seen = F.date_format("first_seen", "yyyyMM")
    ok = (seen < F.col("month")) if strict else (seen <= F.col("month"))
    j = regions_months.alias("g").join(stations.withColumnRenamed("region_id", "_r"), (F.col("g.region_id") == F.col("_r")) & ok, "left")
    return j.groupBy("g.region_id", "month").agg(F.count("station_id").alias("active_station_count"), (F.count("station_id") / F.first("area_km2")).alias("station_density_km2"), F.coalesce(F.sum("appearances"), F.lit(0)).alias("region_hist_trip_volume"))
