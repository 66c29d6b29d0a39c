"""Queries on inventories, rebalancing, routing and serving."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from quadrille.functions import explain, metrics, timeutil
from quadrille.operators import inventory as I
from quadrille.operators import panel as P
from quadrille.operators import models, routing, spatial
from quadrille.plans.context_queries import KM, STATIONS, stations
from quadrille.plans.panel_queries import PANEL, ZONE, panel
from quadrille.plans import serving
from quadrille.plans.registry import query, table

_MOVES = "m AS (SELECT user_id AS station_id, CAST(ts AS DATE) AS day, ts, event_id AS tie, CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END AS delta FROM events)"
_FLOW = f"""{_MOVES}, q AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY station_id, day ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m),
flow AS (SELECT station_id, day, min(run) AS min_flow, max(run) AS max_flow, max(run) - min(run) AS flow_range, count(*) AS day_trips, arg_max(run, (ts, tie)) AS end_flow FROM q GROUP BY 1, 2)"""
_CAP = f"""{_FLOW}, raw AS (SELECT station_id, list_sort(list(flow_range))[CAST(floor(0.95 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS raw, count(*) AS observed_days, CAST(sum(day_trips) AS BIGINT) AS total_trips FROM flow GROUP BY 1),
own AS (SELECT *, greatest(raw, 8) AS own FROM raw), e AS (SELECT quantile_cont(total_trips, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM own),
placed AS (SELECT own.*, (SELECT count(*) FROM (SELECT unnest(e.edges) AS x) y WHERE x < own.total_trips) AS decile FROM own, e), mid AS (SELECT decile, median(own) AS middle FROM placed WHERE observed_days >= 28 GROUP BY 1),
cap AS (SELECT station_id, observed_days, total_trips, p.decile, CASE WHEN observed_days < 28 AND middle IS NOT NULL THEN CAST(floor(middle) AS BIGINT) ELSE own END AS capacity, CASE WHEN observed_days < 28 THEN 'volume_decile_median' ELSE 'flow_q95' END AS capacity_source FROM placed p LEFT JOIN mid ON p.decile = mid.decile)"""


def moves(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("station_id"), F.to_date("ts").alias("day"), "ts", F.col("event_id").alias("tie"), F.when(F.col("event_id") % 2 == 1, -1).otherwise(1).alias("delta"))


@query(f"WITH {_FLOW} SELECT station_id, strftime(day, '%Y-%m-%d') AS day, min_flow, max_flow, flow_range, day_trips, end_flow FROM flow")
def daily_flow(spark, d):
    return I.daily_flow(moves(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {_CAP} SELECT * FROM cap")
def capacity_estimate(spark, d):
    return I.capacity(I.daily_flow(moves(spark, d)), days=28)


_START = f"""{_CAP}, j AS (SELECT flow.station_id, day, min_flow AS lo, max_flow AS hi, capacity AS c, greatest(0, -min_flow)::DOUBLE AS floor, least(capacity, capacity - max_flow)::DOUBLE AS roof FROM flow JOIN cap USING (station_id)),
o AS (SELECT *, floor AS s, 0 AS i FROM j UNION ALL SELECT *, roof, 1 FROM j UNION ALL SELECT *, c / 2, 2 FROM j), misses AS (SELECT *, greatest(0, -(s + lo)) + greatest(0, s + hi - c) AS miss FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY station_id, day ORDER BY miss + abs(s - c / 2) * 0.001::DOUBLE, i) AS n FROM misses),
k AS (SELECT station_id, day, c, CASE WHEN floor > roof THEN least(greatest(s, 0), c) WHEN c / 2 < floor THEN floor WHEN c / 2 > roof THEN roof ELSE c / 2 END AS s, CASE WHEN floor > roof THEN miss ELSE 0 END AS err FROM b WHERE n = 1)"""


def station_days(spark, d):
    flow = I.daily_flow(moves(spark, d))
    j = flow.join(I.capacity(flow, days=28).select("station_id", "capacity"), "station_id")
    s, err = I.start_inventory(F.col("min_flow"), F.col("max_flow"), F.col("capacity"))
    return j.withColumn("start_inventory", s).withColumn("fit_error", err)


@query(f"WITH {_START} SELECT station_id, strftime(day, '%Y-%m-%d') AS day, c AS capacity, CAST(round_even(s, 0) AS BIGINT) AS start_inventory, round(err, 6) AS inventory_fit_error, err > 2 AS inventory_unreliable FROM k")
def start_inventory(spark, d):
    return station_days(spark, d).select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "capacity", F.bround("start_inventory").cast("long").alias("start_inventory"), F.round("fit_error", 6).alias("inventory_fit_error"), (F.col("fit_error") > 2).alias("inventory_unreliable"))


@query(f"WITH {_START} SELECT CAST(station_id % 16 AS VARCHAR) AS region_id, strftime(day, '%Y-%m-%d') AS day, CAST(sum(c) AS BIGINT) AS capacity, CAST(sum(round_even(s, 0)) AS BIGINT) AS start_inventory, round(avg(err), 6) AS fit_error FROM k GROUP BY 1, 2")
def region_inventory(spark, d):
    return station_days(spark, d).groupBy((F.col("station_id") % 16).cast("string").alias("region_id"), F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.sum("capacity").alias("capacity"), F.sum(F.bround("start_inventory").cast("long")).alias("start_inventory"), F.round(F.avg("fit_error"), 6).alias("fit_error"))


@query()
def simulate_no_moves(spark, d):
    """All bins of the panel; a recursive query is too dear for them, so checked by a loop in tests."""
    p = panel(spark, d)
    start = p.select("region_id").distinct().withColumn("inventory", F.lit(10).cast("long")).withColumn("capacity", F.lit(20).cast("long"))
    return I.simulate(p, start)


@query(f"""WITH {PANEL}, f AS (SELECT region_id, ts, lag(pickups, 95) OVER w AS a, lag(dropoffs, 95) OVER w AS b FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)), p AS (SELECT region_id, ts, least(greatest(6 + b - a * 3, 0), 20) AS level FROM f WHERE a IS NOT NULL)
SELECT region_id, ts, level AS projected_inventory, CASE WHEN level < 4 THEN (4 - level)::DOUBLE ELSE 0 END AS shortage, CASE WHEN level > 10 THEN (level - 10)::DOUBLE ELSE 0 END AS surplus FROM p""")
def shortage_surplus(spark, d):
    """A safety share of 0.2 and a target share of 0.5 of 20 docks."""
    f = panel(spark, d).select("region_id", "ts", F.lag("pickups", 95).over(P.by_region()).alias("a"), F.lag("dropoffs", 95).over(P.by_region()).alias("b")).dropna()
    level = I.projected(F.lit(6), F.col("a") * 3, F.col("b"), F.lit(20)).cast("long")
    p = f.select("region_id", "ts", level.alias("projected_inventory"))
    low, high = I.shortage_surplus(F.col("projected_inventory"), F.lit(20.0), 0.2, 0.5)
    return p.withColumn("shortage", low).withColumn("surplus", high)


SWEEP = [("no_rebalancing", None, None), *((f"{f} {int(100 * s)}%", f, s) for f in ("foresight", "same_week") for s in (0.0, 0.05, 0.10))]


def sweep_steps(spark, d):
    """The panel with two forecasts of the next four bins: what will happen, and the same bins a week before."""
    p, w = panel(spark, d), P.by_region()
    ahead = lambda c, a: F.coalesce(F.sum(c).over(w.rowsBetween(a, a + 3)), F.lit(0))
    spots = p.select("region_id").distinct().withColumn("k", F.crc32("region_id") % 100)
    s = p.select("region_id", "ts", "pickups", "dropoffs", *(ahead(c, a).alias(f"{f}_{side}") for f, a in (("foresight", 1), ("same_week", -671)) for c, side in (("pickups", "out"), ("dropoffs", "in"))))
    return s.join(F.broadcast(spots), "region_id").select("*", F.lit(5).cast("long").alias("inventory"), F.lit(10).cast("long").alias("capacity"), (40.6 + F.col("k") / 5000).alias("lat"), (-74.0 + F.col("k") / 7000).alias("lng")).drop("k")


@query()
def strategy_sweep(spark, d):
    """Service with rebalancing over the whole panel, for forecasts and safety shares; sequential, so checked by tests."""
    return I.strategies(sweep_steps(spark, d), SWEEP)


@query("""WITH s AS (SELECT user_id AS station_id, any_value(user_id % 16) AS region_id, count(*) FILTER (WHERE event_id % 2 = 1 AND user_id % 16 <> 3) AS p, count(*) FILTER (WHERE event_id % 2 = 0 AND user_id % 16 <> 5) AS q FROM events GROUP BY 1),
r AS (SELECT region_id, sum(p)::DOUBLE AS rp, sum(q)::DOUBLE AS rq, count(*) AS n FROM s GROUP BY 1)
SELECT station_id, s.region_id, p AS pickups, q AS dropoffs, round(CASE rp WHEN 0 THEN 1 / n ELSE p / rp END, 6) AS pickup_share, round(CASE rq WHEN 0 THEN 1 / n ELSE q / rq END, 6) AS dropoff_share, p + q AS lifetime_trips, CASE WHEN p + q < 70 THEN 'low' ELSE 'high' END AS share_confidence FROM s JOIN r ON s.region_id = r.region_id""")
def share_split(spark, d):
    """The tables' stations have far fewer than 2,000 trips: here 70 are enough for a share to be trusted."""
    e = table(spark, d, "events")
    s = e.groupBy(F.col("user_id").alias("station_id"), (F.col("user_id") % 16).alias("region_id")).agg(
        F.count_if((F.col("event_id") % 2 == 1) & (F.col("user_id") % 16 != 3)).alias("pickups"), F.count_if((F.col("event_id") % 2 == 0) & (F.col("user_id") % 16 != 5)).alias("dropoffs"))
    return I.shares(s, 70).withColumns({c: F.round(c, 6) for c in ("pickup_share", "dropoff_share")})


_HOUR = "h AS (SELECT user_id % 16 AS region_id, date_trunc('hour', ts) AS ts, count(*) FILTER (WHERE event_id % 2 = 1)::DOUBLE AS p, count(*) FILTER (WHERE event_id % 2 = 0)::DOUBLE AS q FROM events GROUP BY 1, 2)"


def hourly(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("region_id"), F.window("ts", "1 hour")["start"].alias("ts")).agg(F.count_if(F.col("event_id") % 2 == 1).cast("double").alias("p"), F.count_if(F.col("event_id") % 2 == 0).cast("double").alias("q"))


# independent of the code: total below 1 is quiet and costs 275 m, else 550 m times the outflow's share
_PRESSURE = "CASE WHEN p + q >= 1 THEN (q - p) / (p + q) END"
_PENALTY = "CASE WHEN p + q < 1 THEN 0.275::DOUBLE WHEN p > q THEN 0.55::DOUBLE * (p - q) / (p + q) ELSE 0 END"


@query(f"""WITH {_HOUR}, x AS (SELECT *, {_PRESSURE} AS x FROM (SELECT region_id, ts, p * 0.4::DOUBLE AS p, q * 0.4::DOUBLE AS q FROM h) y)
SELECT region_id, ts, round(x, 6) + 0.0 AS pressure, CASE WHEN x IS NULL THEN 'quiet' WHEN x >= 0.25 THEN 'crowded' WHEN x >= 0.05 THEN 'filling' WHEN x > -0.05 THEN 'balanced' WHEN x > -0.25 THEN 'tightening' ELSE 'draining' END AS verdict, round({_PENALTY}, 6) + 0.0 AS penalty_km FROM x""")
def availability_verdict(spark, d):
    """Hourly flows, of which a place has four tenths, so that some are quiet."""
    h = hourly(spark, d).withColumns({c: F.col(c) * 0.4 for c in ("p", "q")})
    p, q = F.col("p"), F.col("q")
    return h.select("region_id", "ts", (F.round(I.pressure(p, q), 6) + 0.0).alias("pressure"), I.verdict(p, q).alias("verdict"), (F.round(I.pressure_penalty_km(p, q), 6) + 0.0).alias("penalty_km"))


_PRED = f"""{PANEL}, f AS (SELECT region_id, ts, lead(pickups, 1) OVER w AS actual, lag(pickups, 95) OVER w AS predicted, isodow(ts) >= 6 AS is_weekend, hour(ts) AS hour FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)), g AS (SELECT * FROM f WHERE actual IS NOT NULL AND predicted IS NOT NULL)"""
_ERR = "count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse, round(sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0), 6) AS wape, round(avg(predicted - actual), 6) AS bias, round(avg(actual), 6) AS actual_mean, round(avg(CASE WHEN actual = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share"


def predictions(spark, d):
    w = P.by_region()
    return panel(spark, d).select("region_id", "ts", F.lead("pickups", 1).over(w).alias("actual"), F.lag("pickups", 95).over(w).alias("predicted")).dropna()


@query(f"WITH {_PRED} SELECT {_ERR} FROM g")
def metrics_all(spark, d):
    return metrics.evaluate(predictions(spark, d), [])


@query(f"""WITH {_PRED}, x AS (SELECT 'hour' AS dimension, CAST(hour AS VARCHAR) AS level, actual, predicted FROM g UNION ALL SELECT 'weekend', CAST(is_weekend AS VARCHAR), actual, predicted FROM g UNION ALL SELECT 'region', region_id, actual, predicted FROM g) SELECT dimension, level, {_ERR} FROM x GROUP BY 1, 2""")
def error_breakdowns(spark, d):
    g = predictions(spark, d)
    hour, weekend = F.hour("ts").cast("string"), (F.extract(F.lit("dayofweek_iso"), "ts") >= 6).cast("string")
    pairs = F.array(*(F.struct(F.lit(n).alias("dimension"), c.alias("level")) for n, c in (("hour", hour), ("weekend", weekend), ("region", F.col("region_id")))))
    return metrics.evaluate(g.select("actual", "predicted", F.inline(pairs)), ["dimension", "level"])


@query(f"""WITH {_PRED}, r AS (SELECT row_number() OVER (PARTITION BY ts ORDER BY actual DESC, region_id) AS a, row_number() OVER (PARTITION BY ts ORDER BY predicted DESC, region_id) AS b, greatest(1, round_even(count(*) OVER (PARTITION BY ts) * 0.3, 0)) AS k FROM g),
c AS (SELECT count(*) FILTER (WHERE a <= k AND b <= k) AS hits, count(*) FILTER (WHERE b <= k) AS called, count(*) FILTER (WHERE a <= k) AS hot FROM r)
SELECT hits, called, hot, round(hits::DOUBLE / called, 6) AS precision, round(hits::DOUBLE / hot, 6) AS recall, round(2.0::DOUBLE * hits / (called + hot), 6) AS f1 FROM c""")
def hotspot_f1(spark, d):
    return metrics.hotspots(predictions(spark, d), share=0.3)


@query(f"WITH {_PRED} SELECT region_id, ts, abs(predicted - actual) AS error FROM g ORDER BY error DESC, ts, region_id LIMIT 100")
def top_errors(spark, d):
    """A top-100 report: the limit is the feature."""
    return predictions(spark, d).select("region_id", "ts", F.abs(F.col("predicted") - F.col("actual")).alias("error")).orderBy(F.desc("error"), "ts", "region_id").limit(100)


@query("SELECT user_id AS region_id, count(*) AS pickups FROM events GROUP BY 1 ORDER BY pickups DESC, region_id LIMIT 12")
def top_regions(spark, d):
    """A top-12 report: the limit is the feature."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("region_id")).agg(F.count("*").alias("pickups")).orderBy(F.desc("pickups"), "region_id").limit(12)


_LADDER = (("A", "{0}"), ("B", "lag({0}, 95) OVER w"), ("C", "avg({0}) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"), ("D", "avg({0}) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)"), ("E", "avg({0}) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 100 PRECEDING AND CURRENT ROW)"))


@query(f"""WITH {PANEL}, f AS (SELECT region_id, {', '.join(f"lead({n}, 1) OVER w AS y_{n}, " + ', '.join(f"{e.format(n)} AS {k}_{n}" for k, e in _LADDER) for n in ('pickups', 'dropoffs'))} FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)),
m AS ({' UNION ALL '.join(f"SELECT '{k}' AS step, '{n}' AS target, avg(abs({k}_{n} - y_{n})) AS mae FROM f WHERE y_{n} IS NOT NULL AND B_{n} IS NOT NULL" for n in ('pickups', 'dropoffs') for k, _ in _LADDER)}),
g AS (SELECT b.step, b.target, b.mae, 100 * (a.mae - b.mae) / a.mae AS gain FROM m b LEFT JOIN m a ON a.target = b.target AND ord(a.step) = ord(b.step) - 1), k AS (SELECT step, avg(gain) AS mean FROM g GROUP BY 1)
SELECT g.step, target, round(mae, 6) AS mae, round(gain, 3) AS gain_pct, round(mean, 3) AS mean_gain_pct, CASE WHEN mean > 0.05 THEN 'HELPS' WHEN mean <= -0.05 THEN 'HURTS' WHEN mean IS NOT NULL THEN 'no effect' END AS verdict FROM g JOIN k ON g.step = k.step""")
def ablation_delta(spark, d):
    """A ladder of forecasts in place of trained families: each step's error against the step before, over the same rows."""
    w = P.by_region()
    made = lambda n: {"A": F.col(n), "B": F.lag(n, 95).over(w), "C": F.avg(n).over(P.frame(4)), "D": F.avg(n).over(P.frame(96)), "E": F.avg(n).over(P.frame(101))}
    cols = [F.struct(F.lit(n).alias("target"), F.lit(k).alias("step"), c.cast("double").alias("x"), F.lead(n, 1).over(w).alias("y")).alias(f"{k}_{n}") for n in ("pickups", "dropoffs") for k, c in made(n).items()]
    f = panel(spark, d).select(F.lead("pickups", 1).over(w).alias("_y"), F.lag("pickups", 95).over(w).alias("_b"), *cols).dropna(subset=["_y", "_b"])
    long = f.select(F.inline(F.array(*(F.col(f"{k}_{n}") for n in ("pickups", "dropoffs") for k in "ABCDE"))))
    return metrics.verdicts(long.groupBy("step", "target").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae")))


@query(f"""WITH {PANEL}, f AS (SELECT region_id, lead(pickups, 1) OVER w AS y, lag(pickups, 95) OVER w AS a, lag(pickups, 671) OVER w AS b, avg(pickups) OVER (PARTITION BY region_id ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS m FROM panel WINDOW w AS (PARTITION BY region_id ORDER BY ts)),
e AS (SELECT region_id, avg(abs(a - y)) AS day, avg(abs(b - y)) AS week, avg(abs(m - y)) AS model FROM f WHERE y IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT region_id, round(day, 6) AS day, round(week, 6) AS week, round(model, 6) AS model, CASE WHEN day <= week THEN 'same_day' ELSE 'same_week' END AS best_naive, round(1 - model / nullif(least(day, week), 0), 6) AS skill, model < least(day, week) AS passes FROM e""")
def skill_gate(spark, d):
    """Skill of a moving mean over the better naive forecast at the same rows, and whether it passes."""
    w = P.by_region()
    f = panel(spark, d).select("region_id", F.lead("pickups", 1).over(w).alias("y"), F.lag("pickups", 95).over(w).alias("a"), F.lag("pickups", 671).over(w).alias("b"), F.avg("pickups").over(P.frame(96)).alias("m")).filter("y is not null and b is not null")
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("y")))
    e = f.groupBy("region_id").agg(mae("a").alias("day"), mae("b").alias("week"), mae("m").alias("model"))
    best = F.least("day", "week")
    return e.select("region_id", *(F.round(c, 6).alias(c) for c in ("day", "week", "model")), F.when(F.col("day") <= F.col("week"), "same_day").otherwise("same_week").alias("best_naive"), F.round(metrics.skill(F.col("model"), best), 6).alias("skill"), (F.col("model") < best).alias("passes"))


# at 13:00 UTC the last known bin is that of 12:45, and horizon 3 is the third from there
_AT = "TIMESTAMP '2024-01-20 13:00:00'"
_DAY = f"l AS (SELECT p.region_id, h, q.pickups::DOUBLE AS p, q.dropoffs::DOUBLE AS q FROM (SELECT DISTINCT region_id FROM panel) p, (SELECT unnest([1, 2, 3]) AS h) x JOIN panel q ON q.ts = {_AT} - INTERVAL 15 MINUTE + h * INTERVAL 15 MINUTE - INTERVAL 1 DAY WHERE q.region_id = p.region_id), k AS (SELECT region_id, sum(p) AS cp, sum(q) AS cq, max(CASE WHEN h = 3 THEN p END) AS p, max(CASE WHEN h = 3 THEN q END) AS q FROM l GROUP BY 1)"


def serving_engine(spark, d):
    """The panel and a stand-in inventory: 20 docks a region, ten bikes at the start of each day."""
    p = panel(spark, d)
    stock = p.select("region_id", F.to_date("ts").alias("day")).distinct().select("region_id", "day", F.lit(20).alias("capacity"), F.lit(10).alias("start_inventory"))
    return serving.Engine(p, inventory=stock)


_WHEN = datetime(2024, 1, 20, 13, tzinfo=timezone.utc)


@query(f"""WITH {PANEL}, {_DAY}, z AS (SELECT *, least(greatest(10 + cq - cp, 0), 20) AS level FROM k)
SELECT region_id, {_AT} AS forecast_time, 3 AS horizon, p AS predicted_pickups, q AS predicted_dropoffs, level AS projected_inventory, greatest(1 - level, 0) AS shortage, greatest(level - 10, 0) AS surplus, cp AS cumulative_predicted_pickups, cq AS cumulative_predicted_dropoffs,
20::DOUBLE AS capacity, 'seasonal_naive_same_day' AS model, true AS inventory_estimated FROM z""")
def predict_naive(spark, d):
    return serving_engine(spark, d).predict("seasonal_naive_same_day", _WHEN, 3)


@query(f"""WITH {PANEL}, {_DAY}, s AS (SELECT user_id AS station_id, event_type AS region_id, count(*) FILTER (WHERE event_id % 2 = 1) AS a, count(*) FILTER (WHERE event_id % 2 = 0) AS b FROM events GROUP BY 1, 2), t AS (SELECT region_id, sum(a) AS sa, sum(b) AS sb, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT s.station_id, s.region_id, k.p * CASE sa WHEN 0 THEN 1 / n ELSE a / sa END AS p, k.q * CASE sb WHEN 0 THEN 1 / n ELSE b / sb END AS q FROM s JOIN t ON s.region_id = t.region_id JOIN k ON k.region_id = s.region_id)
SELECT station_id, region_id, round(p, 6) AS predicted_pickups, round(q, 6) AS predicted_dropoffs, CASE WHEN p + q < 1 THEN 'quiet' WHEN (q - p) / (p + q) <= -0.25 THEN 'draining' WHEN (q - p) / (p + q) <= -0.05 THEN 'tightening' WHEN (q - p) / (p + q) < 0.05 THEN 'balanced' WHEN (q - p) / (p + q) < 0.25 THEN 'filling' ELSE 'crowded' END AS verdict FROM f""")
def station_forecast(spark, d):
    """A region's forecast by its stations' shares."""
    e = table(spark, d, "events")
    s = e.groupBy(F.col("user_id").alias("station_id"), F.col("event_type").alias("region_id")).agg(F.count_if(F.col("event_id") % 2 == 1).alias("pickups"), F.count_if(F.col("event_id") % 2 == 0).alias("dropoffs"))
    f = serving.station_forecast(serving_engine(spark, d).predict("seasonal_naive_same_day", _WHEN, 3), I.shares(s).drop("pickups", "dropoffs"))
    return f.select("station_id", "region_id", *(F.round(c, 6).alias(c) for c in ("predicted_pickups", "predicted_dropoffs")), "verdict")


@query("WITH n AS (SELECT event_id, 1 + CAST(('0x' || substr(md5(CAST(ts AS VARCHAR)), 1, 6))::BIGINT % 10000 AS BIGINT) AS h FROM events) SELECT event_id FROM n WHERE h <= 2500".replace("CAST(ts AS VARCHAR)", "strftime(ts, '%Y-%m-%d %H:%M')"))
def hash_sample(spark, d):
    """Whole timestamps by hash: rows of one time stay or go together.  A sampling operator: the share is the feature."""
    h = F.conv(F.substring(F.md5(F.date_format("ts", "yyyy-MM-dd HH:mm")), 1, 6), 16, 10).cast("long") % 10000
    return table(spark, d, "events").filter(h < 2500).select("event_id")


@query("SELECT event_id FROM events WHERE ('0x' || substr(md5('42/' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT < CAST(0.25 * 4294967296 AS BIGINT)")
def row_sample(spark, d):
    """A uniform sample of rows by a seed.  A sampling operator: the share is the feature."""
    return models.sample_rows(table(spark, d, "events"), "event_id", 0.25, 42).select("event_id")


@query("SELECT region_id FROM (SELECT DISTINCT user_id AS region_id FROM events) x ORDER BY md5(CAST(region_id AS VARCHAR)) LIMIT 20")
def region_sample(spark, d):
    """A fixed-size sample by hash order: the size is the feature."""
    return table(spark, d, "events").select(F.col("user_id").alias("region_id")).distinct().orderBy(F.md5(F.col("region_id").cast("string"))).limit(20)


# fifteen regional stations and the roads between those nearest to each other; SQL relaxes all pairs
_E = f"""s AS (SELECT id % 40 AS id, avg(lat) AS lat, avg(lng) AS lng FROM ({STATIONS}) x GROUP BY 1), p AS (SELECT a.id AS u, b.id AS v, {KM.format(a='a.lat', b='a.lng', c='b.lat', d='b.lng')} AS km FROM s a JOIN s b ON a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY km, v) AS i FROM p WHERE km <= 40), g AS (SELECT u, v, km FROM n WHERE i <= 3 UNION SELECT v, u, km FROM n WHERE i <= 3)"""


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT (SELECT u FROM g ORDER BY u LIMIT 1) AS node, 0.0::DOUBLE AS km, 0 AS hops UNION ALL SELECT node, min(km), max(hops) + 1 FROM (SELECT g.v AS node, r.km + g.km AS km, r.hops FROM r JOIN g ON r.node = g.u WHERE r.hops < 40 UNION ALL SELECT node, km, hops FROM r WHERE hops < 40) x GROUP BY node)
SELECT CAST(node AS VARCHAR) AS node, round(min(km), 6) AS km FROM r GROUP BY 1""")
def shortest_path(spark, d):
    """Distances over a road graph from its first node to every node that it reaches."""
    s = stations(spark, d).groupBy((F.col("id") % 40).alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    e = spatial.station_graph(s, 3, 40.0).select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "km")
    source = str(e.agg(F.min(F.col("u").cast("long"))).first()[0])
    return routing.shortest_paths(e, source).withColumn("km", F.round("km", 6))


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT (SELECT u FROM g ORDER BY u LIMIT 1) AS node, 0.0::DOUBLE AS km, 0 AS hops UNION ALL SELECT node, min(km), max(hops) + 1 FROM (SELECT g.v AS node, r.km + g.km AS km, r.hops FROM r JOIN g ON r.node = g.u WHERE r.hops < 40 UNION ALL SELECT node, km, hops FROM r WHERE hops < 40) x GROUP BY node),
m AS (SELECT node, min(km) AS km FROM r GROUP BY 1) SELECT CAST(node AS VARCHAR) AS node, round(km, 6) AS km FROM m WHERE node IN (SELECT max(node) FROM m)""")
def landmark_path(spark, d):
    """The way from a road graph's first node to its last reachable one, through the corridor that landmark distances leave."""
    s = stations(spark, d).groupBy((F.col("id") % 40).alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    e = spatial.station_graph(s, 3, 40.0)
    marks = routing.landmark_distances(e, 3)
    source = e.agg(F.min("u")).first()[0]
    goal = marks.filter(F.get("d", F.lit(0)).isNotNull()).agg(F.max(F.col("node").cast("long"))).first()[0]
    path, km = routing.path_between(e, source, goal, marks)
    return spark.createDataFrame([(str(path[-1]), round(km, 6))], "node string, km double")


@query(f"""WITH s AS ({STATIONS}), w AS (SELECT id % 20 AS way_id, id, lead(id) OVER (PARTITION BY id % 20 ORDER BY id) AS nxt FROM s), e AS (SELECT DISTINCT least(id, nxt) AS u, greatest(id, nxt) AS v FROM w WHERE nxt IS NOT NULL)
SELECT u, v, round({KM.format(a='a.lat', b='a.lng', c='b.lat', d='b.lng')}, 6) AS km FROM e JOIN s a ON e.u = a.id JOIN s b ON e.v = b.id""")
def street_edges(spark, d):
    s = stations(spark, d)
    ways = s.groupBy((F.col("id") % 20).alias("way_id")).agg(F.array_sort(F.collect_list("id")).alias("node_ids"))
    return routing.street_edges(ways, s).withColumn("km", F.round("km", 6))


@query(f"""WITH s AS ({STATIONS}), m AS (SELECT id, {KM.format(a='40.7', b='-74.0', c='lat', d='lng')} AS km FROM s), c AS (SELECT user_id AS id, count(*) FILTER (WHERE event_id % 2 = 1)::DOUBLE AS p, count(*) FILTER (WHERE event_id % 2 = 0)::DOUBLE AS q FROM events GROUP BY 1),
j AS (SELECT id, km, km * 1.3::DOUBLE AS walk, {_PENALTY} AS penalty FROM m JOIN c USING (id)) SELECT id AS station_id, round(walk, 6) AS walk_km, round(walk * 12.5::DOUBLE, 4) AS minutes, walk > 2 AS too_far, km <= 0.75 AS direct, round(penalty, 6) + 0.0 AS penalty_km, round(walk + penalty, 6) AS score FROM j""")
def route_choice(spark, d):
    km = stations(spark, d).select(F.col("id").alias("station_id"), spatial.haversine_km(F.lit(40.7), F.lit(-74.0), "lat", "lng").alias("km"))
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("station_id")).agg(F.count_if(F.col("event_id") % 2 == 1).cast("double").alias("pickups"), F.count_if(F.col("event_id") % 2 == 0).cast("double").alias("dropoffs"))
    r = routing.route_scores(km.join(c, "station_id"))
    return r.select("station_id", F.round("walk_km", 6).alias("walk_km"), F.round("minutes", 4).alias("minutes"), "too_far", "direct", (F.round("penalty_km", 6) + 0.0).alias("penalty_km"), F.round("score", 6).alias("score"))


@query(f"""WITH {PANEL}, l AS (SELECT *, ts - INTERVAL 5 HOUR AS lt, row_number() OVER (PARTITION BY region_id ORDER BY ts) AS i FROM panel), e AS (SELECT a.region_id, a.ts, sum(b.pickups * pow(0.6::DOUBLE, a.i - b.i)) / sum(pow(0.6::DOUBLE, a.i - b.i)) AS recent FROM l a JOIN l b ON a.region_id = b.region_id AND b.i BETWEEN a.i - 63 AND a.i GROUP BY 1, 2),
s AS (SELECT region_id, ts, lt, lag(pickups, 671) OVER (PARTITION BY region_id ORDER BY ts) AS last_week, count(*) OVER w AS n, avg(pickups) OVER w AS mean FROM l WINDOW w AS (PARTITION BY region_id, isodow(lt), hour(lt), minute(lt) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT s.*, e.recent, CASE WHEN n >= 3 THEN mean ELSE 0 END AS typical, lt + INTERVAL 15 MINUTE AS ft FROM s JOIN e ON s.region_id = e.region_id AND s.ts = e.ts)
SELECT region_id, ts, round(recent, 6) AS recent, round(typical, 6) AS typical, CASE WHEN typical > 0 THEN round(100 * abs(recent / typical - 1), 4) END AS percent_off, CASE WHEN typical > 0 THEN CASE WHEN recent >= typical THEN 'above' ELSE 'below' END END AS direction, coalesce(last_week, 0) AS last_week,
['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][isodow(ft)] || ' ' || strftime(ft, '%H:%M') || CASE WHEN hour(lt) BETWEEN 7 AND 9 THEN ', morning rush' ELSE '' END || CASE WHEN hour(lt) BETWEEN 16 AND 18 THEN ', evening rush' ELSE '' END
|| CASE WHEN isodow(lt) > 5 THEN ', weekend' ELSE '' END || CASE WHEN strftime(lt, '%m-%d') IN ('01-01', '01-15') THEN ', public holiday' ELSE '' END || ', winter' AS time_of_week FROM x""")
def explain_drivers(spark, d):
    """What a forecast rests on, for every region and bin: momentum, the same slot last week, the time of the week."""
    local = timeutil.utc_to_local(F.col("ts"), ZONE)
    cols = {"local": local, "recent": P.ewm("pickups", 4), "typical": F.coalesce(P.expanding_slot_mean("pickups", local), F.lit(0.0)), "last_week": F.coalesce(F.lag("pickups", 671).over(P.by_region()), F.lit(0))}
    f = panel(spark, d).select("region_id", "ts", *(c.alias(n) for n, c in cols.items()))
    return explain.drivers(f, F.broadcast(timeutil.holiday_table(spark, (2023, 2024)))).select(
        "region_id", "ts", F.round("recent", 6).alias("recent"), F.round("typical", 6).alias("typical"), F.round("percent_off", 4).alias("percent_off"), "direction", "last_week", "time_of_week")


@query()
def greedy_moves(spark, d):
    """One round of moves per day over all stations; sequential within the day, days are independent tasks; checked by a plain loop in tests.

    The tables' stations are few and far apart: a safety share of 0.35 and a reach of 8 km."""
    from quadrille.session import ship

    flow = station_days(spark, d).join(stations(spark, d).withColumnRenamed("id", "station_id"), "station_id")

    def run(pdf):
        import numpy as np
        import pandas as pd

        r = pdf.sort_values("station_id").reset_index(drop=True)
        cap = r["capacity"].to_numpy(dtype=float)
        level = np.clip(np.round(r["start_inventory"].to_numpy(dtype=float)) + r["end_flow"].to_numpy(dtype=float), 0, cap)
        rows = I.plan_moves(np.maximum(0.35 * cap - level, 0), np.maximum(level - 0.5 * cap, 0), level, cap, I.distances(r["lat"].to_numpy(), r["lng"].to_numpy()), radius_km=8.0)
        who = r["station_id"].tolist()
        return pd.DataFrame([(str(r["day"].iloc[0]), who[a], who[b], n, km) for a, b, n, km in rows], columns=["day", "source", "destination", "bikes_moved", "distance_km"])

    ship(spark)
    return flow.groupBy("day").applyInPandas(run, "day string, source long, destination long, bikes_moved long, distance_km double")
