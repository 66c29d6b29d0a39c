"""Forecast models: seasonal naive and gradient-boosted trees."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import timeutil
from quadrille.storage import discard, materialise


@dataclass(frozen=True)
class Split:
    """Whole local days, first and last included."""

    name: str
    first: date
    last: date

    def contains(self, ts: str, tz: str) -> Column:
        return F.to_date(timeutil.utc_to_local(F.col(ts), tz)).between(F.lit(self.first), F.lit(self.last))

    @property
    def days(self) -> int:
        return (self.last - self.first).days + 1


def split_faults(splits: list[Split], first: date, last: date) -> list[str]:
    """What is wrong with splits that should be in order, contiguous and inside the window; empty if nothing."""
    out = [f"{s.name} ends before it begins" for s in splits if s.last < s.first]
    out += [f"{s.name} leaves the window" for s in splits if s.first < first or s.last > last]
    for a, b in zip(splits, splits[1:]):
        if b.first <= a.last:
            out.append(f"{b.name} overlaps {a.name}")
        elif b.first != a.last + timedelta(days=1):
            out.append(f"there is a gap between {a.name} and {b.name}")
    return out


def naive(target_lag: str) -> Column:
    """The seasonal value, clipped at zero."""
    return F.greatest(F.col(target_lag), F.lit(0))


def sample_rows(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About `share` of the rows, each by itself; the same ones for the same seed and keys, however the table is dealt."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.filter(h < int(share * (1 << 32)))


def poisson_deviance(actual: Column, mean: Column) -> Column:
    """Twice the shortfall of the log-likelihood of a Poisson mean."""
    return 2 * (F.when(actual > 0, actual * F.log(actual / mean)).otherwise(0.0) - (actual - mean))


@dataclass
class Boosted:
    """Regression trees whose sum is the log of a Poisson mean."""

    base: float
    rate: float
    trees: list
    features: list[str]
    history: list[float]

    @property
    def best_rounds(self) -> int:
        return len(self.trees)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """`_x`, the features as a vector; nulls are -1, below every count and share."""
    from pyspark.ml.feature import VectorAssembler

    filled = df.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"_f{i}") for i, c in enumerate(features)))
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(filled).drop(*(f"_f{i}" for i in range(len(features))))


def boosted_trees(train: DataFrame, valid: DataFrame | None, features: list[str], target: str, rounds: int = 20, depth: int = 5, rate: float = 0.3, patience: int = 3, seed: int = 7) -> Boosted:
    """Gradient-boosted trees for counts: each round fits a weighted regression tree to the Poisson loss's Newton step.

    With `valid` it stops when the deviance there hasn't fallen for `patience` rounds and keeps the trees of the best.  The
    running sums are a table in the shared folder after every round, so plans don't grow."""
    from pyspark.ml.regression import DecisionTreeRegressor

    y = F.col(target).cast("double")
    rows = train.select(y.alias("_y"), *features, F.lit(False).alias("_held"))
    if valid is not None:
        rows = rows.unionByName(valid.select(y.alias("_y"), *features, F.lit(True).alias("_held")))
    rows = assembled(rows.filter("_y is not null"), features).select("_y", "_x", "_held")
    mean = rows.filter("not _held").agg(F.avg("_y")).first()[0] or 0.0
    base = math.log(max(mean, 1e-6))
    rows = materialise(rows.withColumn("_raw", F.lit(base)), "boosting")
    trees, history, best = [], [], (float("inf"), 0)
    for r in range(rounds):
        mu = F.exp("_raw")
        step = rows.withColumns({"_mu": mu, "_z": (F.col("_y") - mu) / mu})
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_z", weightCol="_mu", predictionCol="_step", maxDepth=depth, minInstancesPerNode=20, seed=seed + r).fit(step.filter("not _held"))
        raw = F.least(F.greatest(F.col("_raw") + rate * F.col("_step"), F.lit(-12.0)), F.lit(12.0))
        old, rows = rows, materialise(tree.transform(rows).withColumn("_raw", raw).select("_y", "_x", "_held", "_raw"), "boosting")
        discard(old)
        trees.append(tree)
        if valid is not None:
            history.append(rows.filter("_held").agg(F.avg(poisson_deviance(F.col("_y"), F.exp("_raw")))).first()[0])
            best = min(best, (history[-1], r + 1))
            if r + 1 - best[1] >= patience:
                break
    discard(rows)
    return Boosted(base, rate, trees[: best[1]] if valid is not None else trees, features, history)


def score(model: Boosted, df: DataFrame) -> DataFrame:
    """Adds `predicted`, the expected count."""
    rows = assembled(df, model.features).withColumn("_raw", F.lit(model.base))
    for tree in model.trees:
        raw = F.least(F.greatest(F.col("_raw") + model.rate * F.col("_step"), F.lit(-12.0)), F.lit(12.0))
        rows = tree.copy({tree.predictionCol: "_step"}).transform(rows).withColumn("_raw", raw).drop("_step")
    return rows.withColumn("predicted", F.exp("_raw")).drop("_raw", "_x")


def importances(model: Boosted) -> list[tuple[str, float]]:
    """The features' mean importance over the trees, greatest first."""
    total = [0.0] * len(model.features)
    for tree in model.trees:
        for i, v in enumerate(tree.featureImportances.toArray()):
            total[i] += float(v) / len(model.trees)
    return sorted(zip(model.features, total), key=lambda x: (-x[1], x[0]))


def fit_all(train: DataFrame, valid: DataFrame | None, features: list[str], targets: dict[tuple[str, int], str], **setting) -> dict[tuple[str, int], Boosted]:
    """A model for each kind and horizon, from the names of their target columns."""
    return {key: boosted_trees(train, valid, features, target, **setting) for key, target in targets.items()}


def grid_search(train: DataFrame, valid: DataFrame, features: list[str], target: str, grid: list[dict]) -> list[tuple[dict, float]]:
    """Validation MAE of each setting, best first."""
    out = []
    for setting in grid:
        m = boosted_trees(train, valid, features, target, **setting)
        out.append((setting, score(m, valid).agg(F.avg(F.abs(F.col("predicted") - F.col(target)))).first()[0]))
    return sorted(out, key=lambda x: x[1])


def ablation(train: DataFrame, valid: DataFrame, sets: dict[str, list[str]], targets: list[str], **setting) -> DataFrame:
    """step, target, n_features and the validation metrics of a model per cumulative feature set and target; `metrics.verdicts` reads it."""
    from quadrille.functions import metrics

    out = None
    for step, columns in sets.items():
        for target in targets:
            held = score(boosted_trees(train, valid, columns, target, **setting), valid).select(F.col(target).alias("actual"), "predicted")
            rows = metrics.evaluate(held.dropna(), []).select(F.lit(step).alias("step"), F.lit(target).alias("target"), F.lit(len(columns)).alias("n_features"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out
