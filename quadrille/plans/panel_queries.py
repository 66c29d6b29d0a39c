"""Queries on dense panels and their features."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.functions import metrics, timeutil
from quadrille.operators import panel as P
from quadrille.operators import scan
from quadrille.plans.registry import query, table

LO, HI = datetime(2024, 1, 1), datetime(2024, 1, 31)
ZONE = "America/New_York"  # five hours behind UTC over the whole panel, which is how the SQL has it

PANEL = """
grid AS (SELECT region_id, ts FROM (SELECT DISTINCT event_type AS region_id FROM events) r,
  (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTE)) AS ts) b),
cnt AS (SELECT event_type AS region_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) FILTER (WHERE event_id % 2 = 1) AS p,
  count(*) FILTER (WHERE event_id % 2 = 0) AS d FROM events GROUP BY 1, 2),
panel AS (SELECT g.region_id, g.ts, coalesce(c.p, 0) AS pickups, coalesce(c.d, 0) AS dropoffs
  FROM grid g LEFT JOIN cnt c ON g.region_id = c.region_id AND g.ts = c.ts)
"""


def trips(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("region_id"), "ts", (F.col("event_id") % 2 == 1).alias("is_pickup"), F.col("user_id").alias("station_id"), "event_id", "value")


def panel(spark, d):
    t = trips(spark, d)
    return P.dense(t, t.select("region_id").distinct(), LO, HI)


@query(f"WITH {PANEL} SELECT region_id, ts, pickups, dropoffs, dropoffs - pickups AS net_flow FROM panel")
def panel_dense(spark, d):
    return panel(spark, d).withColumn("net_flow", F.col("dropoffs") - F.col("pickups"))


@query(f"""WITH {PANEL} SELECT region_id, ts, {', '.join(f"lead({n}, {h}) OVER w AS {n[:-1]}_h{h}" for n in ('pickups', 'dropoffs') for h in (1, 2, 3, 4))}
FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)""")
def panel_targets(spark, d):
    return panel(spark, d).select("region_id", "ts", *(c.alias(n) for n, c in P.targets().items()))


_STEPS = (*P.LAGS, *range(92, 96), *range(668, 672))


@query(f"""WITH {PANEL}, f AS (SELECT region_id, ts, row_number() OVER w AS n, {', '.join(f"lag({n}, {k}) OVER w AS {n}_lag{k}" for n in ('pickups', 'dropoffs') for k in _STEPS)}
FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)) SELECT * EXCLUDE (n) FROM f WHERE n > 672""")
def lags_basic(spark, d):
    p = panel(spark, d)
    return P.warm(p.select("region_id", "ts", *(c.alias(n) for n, c in P.lags(steps=_STEPS).items())), 672)


@query(f"""WITH {PANEL}, f AS (SELECT *, lead(pickups, 1) OVER w AS actual, lag(pickups, 95) OVER w AS day, lag(pickups, 671) OVER w AS week FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)),
l AS (SELECT region_id, 'same_day' AS model, actual, CASE WHEN day IS NOT NULL THEN greatest(day, 0) END AS predicted FROM f UNION ALL SELECT region_id, 'same_week', actual, CASE WHEN week IS NOT NULL THEN greatest(week, 0) END FROM f)
SELECT region_id, model, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
round(sum(abs(actual - predicted)) / nullif(sum(abs(actual)), 0), 6) AS wape, round(avg(predicted - actual), 6) AS bias, round(avg(actual), 6) AS actual_mean,
round(avg(CASE WHEN actual = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share FROM l WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2""")
def seasonal_naive_eval(spark, d):
    f = panel(spark, d).select("region_id", F.lead("pickups", 1).over(P.by_region()).alias("actual"), F.lag("pickups", 95).over(P.by_region()).alias("same_day"), F.lag("pickups", 671).over(P.by_region()).alias("same_week"))
    long = f.unpivot(["region_id", "actual"], ["same_day", "same_week"], "model", "predicted").dropna(subset=["actual", "predicted"])
    return metrics.evaluate(long.withColumn("predicted", F.greatest("predicted", F.lit(0))), ["region_id", "model"])


@query(f"""WITH {PANEL} SELECT region_id, ts, {', '.join(f"round(avg(pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS pickups_mean{w}, round(stddev_samp(pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS pickups_std{w}, CAST(sum(pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS pickups_sum{w}" for w in (4, 12, 96))} FROM panel""")
def rolling_stats(spark, d):
    cols = P.rolling("pickups", (4, 12, 96))
    return panel(spark, d).select("region_id", "ts", *((c if "sum" in n else F.round(c, 6)).alias(n) for n, c in cols.items()))


@query(f"""WITH {PANEL}, s AS (SELECT region_id, ts, pickups, isodow(ts - INTERVAL 5 HOUR) AS dow, hour(ts - INTERVAL 5 HOUR) * 4 + minute(ts) // 15 AS slot FROM panel),
m AS (SELECT region_id, ts, count(pickups) OVER w AS n, avg(pickups) OVER w AS m FROM s WINDOW w AS (PARTITION BY region_id, dow, slot ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT region_id, ts, CASE WHEN n >= 3 THEN round(m, 6) END AS slot_mean FROM m""")
def expanding_slot_mean(spark, d):
    return panel(spark, d).select("region_id", "ts", F.round(P.expanding_slot_mean("pickups", timeutil.utc_to_local(F.col("ts"), ZONE)), 6).alias("slot_mean"))


@query(f"""WITH {PANEL} SELECT region_id, ts, {', '.join(f"lag(pickups, {s - h}) OVER w AS pickups_season{s}_h{h}" for s in (96, 672) for h in (1, 2, 3, 4))} FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)""")
def seasonal_slots(spark, d):
    return panel(spark, d).select("region_id", "ts", *(c.alias(n) for n, c in P.seasonal_slots("pickups").items()))


@query(f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ts) AS i FROM panel)
SELECT a.region_id, a.ts, round(sum(b.pickups * pow(0.6::DOUBLE, a.i - b.i)) / sum(pow(0.6::DOUBLE, a.i - b.i)), 6) AS pickups_ewm4
FROM n a JOIN n b ON a.region_id = b.region_id AND b.i BETWEEN a.i - 63 AND a.i GROUP BY 1, 2""")
def ewm_span4(spark, d):
    return panel(spark, d).select("region_id", "ts", F.round(P.ewm("pickups", 4), 6).alias("pickups_ewm4"))


@query(f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ts) AS i FROM panel)
SELECT a.region_id, a.ts, round(sum(b.pickups * pow(11.0::DOUBLE / 13, a.i - b.i)) / sum(pow(11.0::DOUBLE / 13, a.i - b.i)), 6) AS pickups_ewm12
FROM n a JOIN n b ON a.region_id = b.region_id AND b.i BETWEEN a.i - 250 AND a.i GROUP BY 1, 2""")
def ewm_span12_exact(spark, d):
    return scan.ewm_means(panel(spark, d), ["pickups"], [12], chunk="day").select("region_id", "ts", F.round("pickups_ewm12", 6).alias("pickups_ewm12"))


@query(f"""WITH {PANEL} SELECT region_id, ts, pickups - lag(pickups, 1) OVER w AS pickups_delta1, pickups - lag(pickups, 2) OVER w AS pickups_delta2, pickups - lag(pickups, 4) OVER w AS pickups_delta4,
round(avg(pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) - avg(pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING), 6) AS pickups_hour_change,
dropoffs - pickups AS net_flow, lag(dropoffs - pickups, 1) OVER w AS net_flow_lag1,
CAST(sum(dropoffs - pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS net_sum4,
CAST(sum(dropoffs - pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS net_sum24,
round((sum(dropoffs) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) + 1)::DOUBLE / (sum(pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) + 1), 6) AS flow_ratio
FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)""")
def deltas_ratio(spark, d):
    return panel(spark, d).select("region_id", "ts", *((F.round(c, 6) if n in ("pickups_hour_change", "flow_ratio") else c).alias(n) for n, c in P.trend().items()))


_HOLIDAYS = ", ".join(f"(DATE '{h}', '{n.replace(chr(39), chr(39) * 2)}')" for y in (2023, 2024) for h, n in timeutil.holidays(y).items())


_LOCAL = "l AS (SELECT event_id, ts - INTERVAL 5 HOUR AS lt FROM events)"


@query(f"""WITH h(holiday_date, holiday_name) AS (VALUES {_HOLIDAYS}), {_LOCAL}
SELECT event_id, hour(lt) AS hour, minute(lt) AS minute, isodow(lt) AS day_of_week, day(lt) AS day_of_month, weekofyear(lt) AS week_of_year, month(lt) AS month_of_year, isodow(lt) IN (6, 7) AS is_weekend, hour(lt) IN (7, 8, 9) AS is_morning_rush, hour(lt) IN (16, 17, 18) AS is_evening_rush,
h.holiday_name IS NOT NULL AS is_holiday, isodow(lt) NOT IN (6, 7) AND h.holiday_name IS NULL AS is_business_day, h.holiday_name, CASE month(lt) // 3 % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season
FROM l LEFT JOIN h ON CAST(lt AS DATE) = h.holiday_date""")
def calendar_features(spark, d):
    e = table(spark, d, "events").select("event_id", timeutil.utc_to_local(F.col("ts"), ZONE).alias("local"))
    e = e.select("event_id", "local", *(c.alias(n) for n, c in timeutil.calendar(F.col("local")).items()))
    h = F.broadcast(timeutil.holiday_table(spark, (2023, 2024)))  # some dozen rows a year
    out = e.join(h, F.to_date("local") == F.col("holiday_date"), "left")
    return out.withColumn("is_holiday", F.col("holiday_name").isNotNull()).withColumn("is_business_day", ~F.col("is_weekend") & F.col("holiday_name").isNull()).withColumn("season", timeutil.season_of(F.col("month_of_year"))).drop("local", "holiday_date")


_TURNS = {"tod": "(hour(lt) * 60 + minute(lt)) / 1440", "dow": "isodow(lt) / 7", "doy": "dayofyear(lt) / 365.25"}


@query(f"WITH {_LOCAL} SELECT event_id, {', '.join(f'round({f}(2 * pi() * {t}), 6) + 0.0 AS {n}_{f}' for n, t in _TURNS.items() for f in ('sin', 'cos'))} FROM l")
def cyclical_encoding(spark, d):
    local = timeutil.utc_to_local(F.col("ts"), ZONE)
    return table(spark, d, "events").select("event_id", *((F.round(c, 6) + 0.0).alias(n) for n, c in timeutil.cyclical(local).items()))


@query(f"""WITH {PANEL}, l AS (SELECT region_id, ts, {', '.join(f"ts - INTERVAL 5 HOUR + {h} * INTERVAL 15 MINUTE AS t{h}" for h in (1, 2, 3, 4))} FROM panel)
SELECT region_id, ts, {', '.join(f"round(sin(pi() * (hour(t{h}) * 60 + minute(t{h})) / 720), 6) + 0.0 AS target_tod_sin_h{h}, round(cos(pi() * (hour(t{h}) * 60 + minute(t{h})) / 720), 6) + 0.0 AS target_tod_cos_h{h}, isodow(t{h}) AS target_weekday_h{h}, hour(t{h}) AS target_hour_h{h}, hour(t{h}) IN (7, 8, 9, 16, 17, 18) AS target_is_rush_h{h}" for h in (1, 2, 3, 4))} FROM l""")
def target_calendar(spark, d):
    cols = []
    for h in P.HORIZONS:
        at = timeutil.utc_to_local(F.col("ts") + F.expr(f"interval {15 * h} minutes"), ZONE)
        cols += [((F.round(c, 6) + 0.0) if "tod" in n else c).alias(n) for n, c in timeutil.target_calendar(at, h).items()]
    return panel(spark, d).select("region_id", "ts", *cols)


_CASES = ["2024-03-10 01:59:59", "2024-03-10 02:00:00", "2024-03-10 02:30:00", "2024-03-10 03:00:00", "2024-11-03 00:30:00", "2024-11-03 01:30:00", "2024-11-03 02:30:00", "2024-07-01 12:00:00", "2024-01-01 12:00:00"]
# The UTC instants of these wall clocks, the first of two ambiguous ones and one hour on for skipped ones.
_UTC = ["2024-03-10 06:59:59", "2024-03-10 07:00:00", "2024-03-10 07:30:00", "2024-03-10 07:00:00", "2024-11-03 04:30:00", "2024-11-03 05:30:00", "2024-11-03 07:30:00", "2024-07-01 16:00:00", "2024-01-01 17:00:00"]


@query("WITH v(local_ts, utc_ts) AS (VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in zip(_CASES, _UTC)) + ") SELECT local_ts, utc_ts FROM v UNION ALL SELECT ts, ts + INTERVAL 5 HOUR FROM events")
def dst_localize(spark, d):
    cases = spark.createDataFrame([(datetime.fromisoformat(x),) for x in _CASES], "local_ts timestamp_ntz")
    return cases.unionByName(table(spark, d, "events").select(F.col("ts").alias("local_ts"))).withColumn("utc_ts", timeutil.local_to_utc(F.col("local_ts"), "America/New_York"))


@query("""WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2024-03-09 00:00:00', TIMESTAMP '2024-03-11 23:00:00', INTERVAL 1 HOUR)) AS ts
UNION ALL SELECT unnest(generate_series(TIMESTAMP '2024-11-02 00:00:00', TIMESTAMP '2024-11-04 23:00:00', INTERVAL 1 HOUR)))
SELECT ts, ts IN (TIMESTAMP '2024-03-10 07:00:00', TIMESTAMP '2024-11-03 05:00:00', TIMESTAMP '2024-11-03 06:00:00') AS dst_unreliable FROM h""")
def dst_unreliable_hours(spark, d):
    changes = timeutil.transitions("America/New_York", date(2024, 1, 1), date(2024, 12, 31))
    hours = spark.range(1).select(F.explode(F.concat(timeutil.bins(datetime(2024, 3, 9), datetime(2024, 3, 12), 60), timeutil.bins(datetime(2024, 11, 2), datetime(2024, 11, 5), 60))).alias("ts"))
    return hours.withColumn("dst_unreliable", timeutil.unreliable_flag(F.col("ts"), changes))


@query("""WITH t AS (SELECT event_type AS region_id, ts, event_id % 2 = 1 AS is_pickup, user_id AS station_id FROM events)
SELECT region_id, count(*) AS total_trips, count(*) FILTER (WHERE is_pickup) AS total_pickups, count(*) FILTER (WHERE NOT is_pickup) AS total_dropoffs, count(DISTINCT CAST(ts AS DATE)) AS active_days,
count(DISTINCT station_id) AS station_count, min(ts) AS first_seen, max(ts) AS last_seen FROM t GROUP BY 1 HAVING count(*) >= 100 AND count(DISTINCT CAST(ts AS DATE)) >= 10""")
def region_activity(spark, d):
    return P.active_regions(trips(spark, d), 100, 10)


@query("""WITH b AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM events), g AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM b)
SELECT before, ts, CAST(date_diff('minute', before, ts) // 15 - 1 AS BIGINT) AS missing_bins FROM g WHERE ts <> before + INTERVAL 15 MINUTE""")
def gap_detection(spark, d):
    b = table(spark, d, "events").select(timeutil.bin_start("ts").alias("ts")).distinct()
    g = b.withColumn("before", F.lag("ts").over(W.orderBy("ts")))  # distinct bins only: one row a bin of the whole window
    gap = F.timestamp_diff("MINUTE", F.col("before"), F.col("ts"))
    return g.filter(gap > 15).select("before", "ts", (F.floor(gap / 15) - 1).cast("long").alias("missing_bins"))


@query(f"""WITH {PANEL}, a AS (SELECT region_id, ts, lead(pickups, 4) OVER w AS x, lag(pickups, 96) OVER w AS y FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts))
SELECT a.region_id, count(*) AS n, count(*) FILTER (WHERE a.x IS NOT DISTINCT FROM f.pickups) AS lead_ok, count(*) FILTER (WHERE a.y IS NOT DISTINCT FROM b.pickups) AS lag_ok
FROM a LEFT JOIN panel f ON a.region_id = f.region_id AND f.ts = a.ts + INTERVAL 60 MINUTE LEFT JOIN panel b ON a.region_id = b.region_id AND b.ts = a.ts - INTERVAL 1440 MINUTE GROUP BY 1""")
def shifted_self_join(spark, d):
    p = panel(spark, d)
    a = p.select("region_id", "ts", F.lead("pickups", 4).over(P.by_region()).alias("x"), F.lag("pickups", 96).over(P.by_region()).alias("y"))
    f = p.select("region_id", (F.col("ts") - F.expr("interval 60 minutes")).alias("ts"), F.col("pickups").alias("fx"))
    b = p.select("region_id", (F.col("ts") + F.expr("interval 1440 minutes")).alias("ts"), F.col("pickups").alias("by"))
    j = a.join(f, ["region_id", "ts"], "left").join(b, ["region_id", "ts"], "left")
    return j.groupBy("region_id").agg(F.count("*").alias("n"), F.count_if(F.col("x").eqNullSafe(F.col("fx"))).alias("lead_ok"), F.count_if(F.col("y").eqNullSafe(F.col("by"))).alias("lag_ok"))


@query(f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ts) - 1 AS i FROM panel)
SELECT region_id, ts, i AS step FROM n WHERE i >= 672 AND i < 2880 - 4 AND (i - 672) % 97 = 0""")
def strided_anchors(spark, d):
    n = panel(spark, d).select("region_id", "ts", (F.row_number().over(P.by_region()) - 1).cast("long").alias("step"), F.lead("ts", 4).over(P.by_region()).alias("end"))
    return n.filter((F.col("step") >= 672) & F.col("end").isNotNull() & ((F.col("step") - 672) % 97 == 0)).drop("end")


@query(f"""WITH {PANEL} SELECT count(*) AS n_rows, count(DISTINCT region_id) AS regions, count(DISTINCT ts) AS bins, round(avg(CASE WHEN pickups = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share,
CAST(sum(pickups) AS BIGINT) AS pickups, CAST(sum(dropoffs) AS BIGINT) AS dropoffs, count(*) FILTER (WHERE pickups IS NULL) AS null_pickups FROM panel""")
def panel_summary(spark, d):
    return panel(spark, d).agg(F.count("*").alias("n_rows"), F.countDistinct("region_id").alias("regions"), F.countDistinct("ts").alias("bins"), F.round(F.avg((F.col("pickups") == 0).cast("double")), 6).alias("zero_share"),
                               F.sum("pickups").alias("pickups"), F.sum("dropoffs").alias("dropoffs"), F.count_if(F.col("pickups").isNull()).alias("null_pickups"))


@query(f"""WITH {PANEL} SELECT region_id, avg(pickups) AS mean, round(stddev_pop(pickups), 6) AS std FROM (SELECT region_id, pickups::DOUBLE AS pickups FROM panel WHERE ts < TIMESTAMP '2024-01-21') GROUP BY 1""".replace("avg(pickups) AS mean", "round(avg(pickups), 6) AS mean"))
def tensor_scaling(spark, d):
    """TRAIN-only mean and population deviation, the scaling of exported tensors."""
    return panel(spark, d).filter("ts < timestamp_ntz'2024-01-21'").groupBy("region_id").agg(F.round(F.avg("pickups"), 6).alias("mean"), F.round(F.stddev_pop("pickups"), 6).alias("std"))


@query("""WITH r AS (SELECT event_type AS region_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS region_idx FROM (SELECT DISTINCT event_type FROM events))
SELECT e.event_id, r.region_id, r.region_idx FROM events e JOIN r ON e.event_type = r.region_id""")
def dense_rank_index(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("region_id"))
    r = e.select("region_id").distinct().withColumn("region_idx", (F.dense_rank().over(W.orderBy("region_id")) - 1).cast("long"))
    return e.join(r, "region_id")
