"""Queries on fitted models."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quadrille.functions import metrics, timeutil
from quadrille.operators import families, leafwise, models, tuning
from quadrille.operators import panel as P
from quadrille.plans.feature_sql import FEATURES_SQL
from quadrille.plans.panel_queries import ZONE, panel
from quadrille.plans.registry import query
from quadrille.storage import materialise


_TARGETS = {(k, h): f"{k}_h{h}" for k in ("pickup", "dropoff") for h in P.HORIZONS}
_SMALL = [c for c in families.family_columns()["A"] if "672" not in c] + ["hour", "day_of_week", "is_weekend", "tod_sin", "tod_cos", "pickups_roll_mean_12", "dropoffs_roll_mean_12"]


def design(spark, d):
    """The panel's own features with the eight targets, and region_idx."""
    p = panel(spark, d)
    local = timeutil.utc_to_local(F.col("ts"), ZONE)
    made = {**families.demand_recent(), **timeutil.calendar(local), **timeutil.cyclical(local), **families.rolling_trend(), **P.targets()}
    return p.select("region_id", "ts", "pickups", "dropoffs", *(made[c].alias(c) for c in [*_SMALL, *_TARGETS.values()]))


@query()
def boosted_trees_eval(spark, d):
    """Eight Poisson models (kind and horizon) with early stopping against the same-day naive forecast on the same held-out rows; fitted models, so checked by tests."""
    rows = materialise(design(spark, d).dropna(subset=[*_TARGETS.values(), "pickups_lag_96"]), "design")
    train, valid, test = models.Split("train", date(2024, 1, 2), date(2024, 1, 18)), models.Split("valid", date(2024, 1, 19), date(2024, 1, 23)), models.Split("test", date(2024, 1, 24), date(2024, 1, 30))
    part = lambda s: rows.filter(s.contains("ts", ZONE))
    fitted = models.fit_all(part(train), part(valid), _SMALL, _TARGETS, rounds=4, depth=3, patience=2)
    long = None
    for (kind, h), m in fitted.items():
        held = models.score(m, part(test)).select("region_id", "ts", F.lit(kind).alias("kind"), F.lit(h).alias("horizon"), F.col(f"{kind}_h{h}").alias("actual"), F.lit("boosted_trees").alias("model"), "predicted")
        naive = part(test).select("region_id", "ts", F.lit(kind).alias("kind"), F.lit(h).alias("horizon"), F.col(f"{kind}_h{h}").alias("actual"), F.lit("same_day").alias("model"), F.col(f"{kind}s_lag_96").cast("double").alias("predicted"))
        long = held.unionByName(naive) if long is None else long.unionByName(held).unionByName(naive)
    return metrics.evaluate(long, ["kind", "horizon", "model"])


def _panel_split(spark, d):
    """Features of the panel as training, validation and test rows."""
    rows = materialise(design(spark, d).dropna(subset=[*_TARGETS.values(), "pickups_lag_96"]), "design")
    return [rows.filter(models.Split(n, a, b).contains("ts", ZONE)) for n, a, b in (("train", date(2024, 1, 2), date(2024, 1, 18)), ("valid", date(2024, 1, 19), date(2024, 1, 23)), ("test", date(2024, 1, 24), date(2024, 1, 30)))]


@query()
def leafwise_trees_eval(spark, d):
    """Leaf-wise Poisson trees with early stopping for one horizon of both kinds, and the naive forecast, on the same held-out rows; fitted models, so checked by tests."""
    train, valid, test = _panel_split(spark, d)
    long = None
    for kind in ("pickup", "dropoff"):
        m = leafwise.fit(train, valid, _SMALL, f"{kind}_h1", leafwise.Setting(rounds=40, rate=0.15, leaves=15, least_rows=50, bins=64, patience=3))
        keys = ["region_id", "ts", F.lit(kind).alias("kind"), F.col(f"{kind}_h1").alias("actual")]
        both = leafwise.score(m, test).select(*keys, F.lit("leafwise_trees").alias("model"), "predicted").unionByName(test.select(*keys, F.lit("same_day").alias("model"), F.col(f"{kind}s_lag_96").cast("double").alias("predicted")))
        long = both if long is None else long.unionByName(both)
    return metrics.evaluate(long, ["kind", "model"])


@query()
def parzen_search_eval(spark, d):
    """Trials of a Parzen search and of a grid of as many settings, with their held-out mean absolute errors; fitted models, so checked by tests."""
    train, valid, _ = _panel_split(spark, d)
    fixed = {"rounds": 4, "bins": 32}
    space = {"leaves": tuning.Range(3, 31, whole=True), "rate": tuning.Range(0.02, 0.8, log=True), "least_rows": tuning.Range(20, 500, whole=True)}
    tried = tuning.tune_trees(train, valid, _SMALL, "pickup_h1", 8, space, at_once=2, seed=5, **fixed)
    grid = [{"leaves": n, "rate": r, "least_rows": k} for n in (3, 31) for r in (0.02, 0.8) for k in (20, 500)]
    rows = [("parzen", i, s, v) for i, (s, v) in enumerate(tried)] + [("grid", i, s, leafwise_error(train, valid, {**fixed, **s})) for i, s in enumerate(grid)]
    return spark.createDataFrame([(how, i, s["leaves"], float(s["rate"]), s["least_rows"], v) for how, i, s, v in rows], "search string, trial int, leaves int, rate double, least_rows int, mae double")


def leafwise_error(train, valid, setting):
    m = leafwise.fit(train, valid, _SMALL, "pickup_h1", leafwise.Setting(**setting))
    return leafwise.score(m, valid).agg(F.avg(F.abs(F.col("predicted") - F.col("pickup_h1")))).first()[0]


@query()
def ablation_eval(spark, d):
    """The ablation loop over two cumulative sets with its verdicts; fitted models, so checked by tests."""
    rows = materialise(design(spark, d).dropna(subset=["pickup_h1", "dropoff_h1", "pickups_lag_96"]), "design")
    train, valid = models.Split("train", date(2024, 1, 2), date(2024, 1, 23)), models.Split("valid", date(2024, 1, 24), date(2024, 1, 30))
    first = [c for c in _SMALL if "_lag_" in c]
    got = models.ablation(rows.filter(train.contains("ts", ZONE)), rows.filter(valid.contains("ts", ZONE)), {"A": first, "B": _SMALL}, ["pickup_h1", "dropoff_h1"], rounds=3, depth=3)
    return metrics.verdicts(got)


_A_TO_C = [c for k in "ABC" for c in families.family_columns()[k]]


@query(FEATURES_SQL)
def series_features(spark, d):
    """The 124 columns of families A to C."""
    rows = families.series_features(panel(spark, d), timeutil.holiday_table(spark, (2023, 2024)), ZONE)
    double = {f.name for f in rows.schema if f.dataType.typeName() == "double"}
    return rows.select("region_id", "ts", *((F.round(c, 5) + 0.0).alias(c) if c in double else F.col(c) for c in _A_TO_C))


_SPLITS = [models.Split("train", date(2024, 1, 1), date(2024, 1, 14)), models.Split("valid", date(2024, 1, 15), date(2024, 1, 21)), models.Split("test", date(2024, 1, 22), date(2024, 1, 30))]


@query("""WITH l AS (SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, value FROM events) SELECT CASE WHEN day BETWEEN DATE '2024-01-01' AND DATE '2024-01-14' THEN 'train' WHEN day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' THEN 'valid' WHEN day BETWEEN DATE '2024-01-22' AND DATE '2024-01-30' THEN 'test' ELSE 'outside' END AS split, count(*) AS n, round(sum(value), 2) AS value FROM l GROUP BY 1""")
def split_rows(spark, d):
    from quadrille.plans.registry import table

    name = F.lit("outside")
    for s in _SPLITS:
        name = F.when(s.contains("ts", "America/New_York"), s.name).otherwise(name)
    return table(spark, d, "events").groupBy(name.alias("split")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
