"""Feature families A to H of a panel, by name, and the cumulative sets of an ablation.

Families A to C come from the panel itself; D to H join weather, event, traffic, neighbour and station tables that are keyed by
time, by region and time, or by region and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.functions import timeutil
from quadrille.operators import external, scan
from quadrille.operators import panel as P

TARGETS = ("pickups", "dropoffs")
SEASONS = {"yesterday": 96, "last_week": 672}
WINDOWS, SPANS, STEPS, FLOWS, STATS = (4, 12, 24, 96, 672), (4, 12, 96), (1, 2, 4), (4, 24), ("sum", "mean", "max")
CALENDAR = ["hour", "minute", "day_of_week", "day_of_month", "week_of_year", "month_of_year", "is_weekend", "is_holiday", "is_business_day", "is_morning_rush", "is_evening_rush"]
CYCLICAL = ["tod_sin", "tod_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos"]
WEATHER = ["temperature_2m", "apparent_temperature", "relative_humidity_2m", "precipitation", "rain", "snowfall", "snow_depth", "wind_speed_10m", "wind_gusts_10m", "cloud_cover"]
EVENTS = ["event_present", "event_count", "event_count_ring", "event_started_recently", "event_ending_soon", "event_attendee_types"]
TRAFFIC = ["traffic_speed_mean", "traffic_speed_min", "traffic_link_count", "congestion_index", "travel_time_index", "traffic_change_15m", "traffic_missing"]
STATIONS = ["active_station_count", "station_density_km2", "region_hist_trip_volume", "region_area_km2"]


def demand_recent() -> dict[str, Column]:
    """The bin that has just ended, and plain lags."""
    return {f"{t}_lag_{k}": F.lag(t, k).over(P.by_region()) if k else F.col(t) for t in TARGETS for k in (0, *P.LAGS)}


def calendar_seasonal(local: Column, holiday: Column, minutes: int = 15, zone: str | None = None) -> dict[str, Column]:
    """Calendar of the bin and of its targets, the seasons' values and the mean of earlier same slots; `local` is the local time of `ts`."""
    out = timeutil.calendar(local) | {"is_holiday": holiday, "is_business_day": ~timeutil.calendar(local)["is_weekend"] & ~holiday}
    out = {c: out[c] for c in CALENDAR} | timeutil.cyclical(local)
    for name, season in SEASONS.items():
        out |= {f"{t}_seasonal_{name}_h{h}": F.lag(t, season - h).over(P.by_region()) for h in P.HORIZONS for t in TARGETS}
    out |= {f"{t}_slot_expanding_mean": P.expanding_slot_mean(t, local, minutes) for t in TARGETS}
    for h in P.HORIZONS:
        ahead = F.expr(f"interval {minutes * h} minutes")
        out |= timeutil.target_calendar(timeutil.utc_to_local(F.col("ts") + ahead, zone) if zone else local + ahead, h)
    return out


def rolling_trend() -> dict[str, Column]:
    """Rolling statistics, differences, hour over hour, net flow and the smoothed ratio of flows (the exponential means are `with_ewm`'s)."""
    out: dict[str, Column] = {}
    for t in TARGETS:
        for n in WINDOWS:
            f = P.frame(n)
            out |= {f"{t}_roll_mean_{n}": F.avg(t).over(f), f"{t}_roll_std_{n}": F.stddev_samp(t).over(f), f"{t}_roll_sum_{n}": F.sum(t).over(f)}
        out |= {f"{t}_delta_{s}": F.col(t) - F.lag(t, s).over(P.by_region()) for s in STEPS}
        out[f"{t}_hour_over_hour"] = F.avg(t).over(P.frame(4)) - F.avg(t).over(P.by_region().rowsBetween(-7, -4))
    net = F.col("dropoffs") - F.col("pickups")
    out |= {f"net_flow_roll_sum_{n}": F.sum(net).over(P.frame(n)) for n in FLOWS}
    hour = lambda c: F.sum(c).over(P.frame(4)) + 1
    return out | {"net_flow_lag_0": net, "net_flow_lag_1": F.lag(net, 1).over(P.by_region()), "dropoff_pickup_ratio_1h": hour("dropoffs") / hour("pickups")}


def with_ewm(panel: DataFrame, spans=SPANS) -> DataFrame:
    """The panel with {target}_ewm_{span}: adjusted exponentially weighted means of whole histories."""
    return scan.ewm_means(panel, list(TARGETS), list(spans), label="{name}_ewm_{span}")


def family_columns() -> dict[str, list[str]]:
    """Column names of each family, by letter."""
    trend = [[f"{t}_roll_{k}_{n}" for n in WINDOWS for k in ("mean", "std", "sum")] + [f"{t}_ewm_{s}" for s in SPANS] + [f"{t}_delta_{s}" for s in STEPS] + [f"{t}_hour_over_hour"] for t in TARGETS]
    target = ("target_tod_sin", "target_tod_cos", "target_weekday", "target_hour", "target_is_rush")
    return {
        "A": [f"{t}_lag_{k}" for t in TARGETS for k in (0, *P.LAGS)],
        "B": [*CALENDAR, *CYCLICAL, *(f"{t}_seasonal_{s}_h{h}" for s in SEASONS for h in P.HORIZONS for t in TARGETS), *(f"{t}_slot_expanding_mean" for t in TARGETS), *(f"{c}_h{h}" for h in P.HORIZONS for c in target)],
        "C": [*trend[0], *trend[1], *(f"net_flow_roll_sum_{n}" for n in FLOWS), "net_flow_lag_0", "net_flow_lag_1", "dropoff_pickup_ratio_1h"],
        "D": [*WEATHER, "is_raining", "is_snowing", "is_freezing", "high_wind", "temp_change_1h", "temp_change_3h", "weather_missing"],
        "E": list(EVENTS),
        "F": list(TRAFFIC),
        "G": [*(f"nb_{t}_{s}" for t in TARGETS for s in STATS), *(f"{t}_vs_neighbor_mean" for t in TARGETS), "neighbor_count"],
        "H": list(STATIONS)}


def cumulative_sets() -> dict[str, list[str]]:
    """Per letter, region_id and the columns of all families up to it."""
    out, so_far = {}, ["region_id"]
    for k, cols in family_columns().items():
        so_far = so_far + cols
        out[k] = so_far
    return out


def series_features(panel: DataFrame, holidays: DataFrame, zone: str, minutes: int = 15) -> DataFrame:
    """The panel(region_id, ts, pickups, dropoffs) with families A to C; holidays(holiday_date, ...) are local dates."""
    local = timeutil.utc_to_local(F.col("ts"), zone)
    base = with_ewm(panel.select("region_id", "ts", *TARGETS)).withColumn("_local", local)
    base = base.join(F.broadcast(holidays.select("holiday_date")), F.to_date("_local") == F.col("holiday_date"), "left")
    made = demand_recent() | calendar_seasonal(F.col("_local"), F.col("holiday_date").isNotNull(), minutes, zone) | rolling_trend()
    return base.select("*", *(c.alias(n) for n, c in made.items())).drop("_local", "holiday_date")


def context_features(rows: DataFrame, weather: DataFrame, events: DataFrame, traffic: DataFrame, edges: DataFrame, stations: DataFrame, zone: str, minutes: int = 15) -> DataFrame:
    """rows(region_id, ts, pickups, dropoffs, ...) with families D to H.

    weather(weather_timestamp, `WEATHER` columns) is matched at the hour of the forecast, events and traffic by (region_id, ts), the
    neighbours' demand over edges(region_id, neighbor_id), stations(region_id, month, `STATIONS` columns) by local month."""
    w = P.by_region()
    hour = F.date_trunc("hour", F.col("ts") + F.expr(f"interval {minutes} minutes")).cast("timestamp_ntz")
    out = rows.withColumn("_hour", hour).join(weather.select("weather_timestamp", *WEATHER), F.col("_hour") == F.col("weather_timestamp"), "left")
    out = out.join(events.select("region_id", "ts", *EVENTS[1:]), ["region_id", "ts"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in EVENTS[1:]})
    speeds = traffic.withColumn("traffic_change_15m", external.change("traffic_speed_mean"))
    out = out.join(speeds.select("region_id", "ts", *TRAFFIC[:-1], F.lit(True).alias("_seen")), ["region_id", "ts"], "left")
    near = edges.select("region_id", F.col("neighbor_id").alias("_n")).join(rows.select(F.col("region_id").alias("_n"), "ts", *TARGETS), "_n")
    near = near.groupBy("region_id", "ts").agg(*(f(t).alias(f"nb_{t}_{s}") for t in TARGETS for s, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max))), F.count("*").alias("neighbor_count"))
    out = out.join(near, ["region_id", "ts"], "left")
    out = out.withColumn("month", F.date_format(timeutil.utc_to_local(F.col("ts"), zone), "yyyyMM")).join(stations.select("region_id", "month", *STATIONS), ["region_id", "month"], "left")
    temp = F.col("temperature_2m")
    return out.withColumns({
        "is_raining": F.col("rain") > 0.1, "is_snowing": F.col("snowfall") > 0.1, "is_freezing": temp < 0, "high_wind": F.col("wind_speed_10m") > 30, "weather_missing": F.col("weather_timestamp").isNull(),
        "temp_change_1h": temp - F.lag(temp, 4).over(w), "temp_change_3h": temp - F.lag(temp, 12).over(w), "event_present": F.col("event_count") > 0, "traffic_missing": F.col("_seen").isNull(),
        **{f"{t}_vs_neighbor_mean": F.col(t) - F.col(f"nb_{t}_mean") for t in TARGETS}}).drop("_hour", "weather_timestamp", "_seen", "month")
