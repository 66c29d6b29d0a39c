"""Forecast metrics in one aggregation pass, and ranking metrics per timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def error_columns(actual: str = "actual", predicted: str = "predicted", digits: int = 6) -> list[Column]:
    """n, MAE, RMSE, WAPE (null where nothing happened), bias, mean and share of zeros."""
    a, p = F.col(actual), F.col(predicted)
    e = p - a
    r = lambda c, n: F.round(c, digits).alias(n)
    return [
        F.count("*").alias("n"), r(F.avg(F.abs(e)), "mae"), r(F.sqrt(F.avg(e * e)), "rmse"), r(F.sum(F.abs(e)) / F.nullif(F.sum(F.abs(a)), F.lit(0)), "wape"),
        r(F.avg(e), "bias"), r(F.avg(a), "actual_mean"), r(F.avg((a == 0).cast("double")), "zero_share")]


def evaluate(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*error_columns())


def hotspots(df: DataFrame, by: str = "ts", tie: str = "region_id", share: float = 0.10) -> DataFrame:
    """Micro-averaged precision, recall and F1 of the top share of regions at each time; ties go to the lesser region.

    The top has max(1, n * share rounded half to even) regions."""
    rank = lambda c: F.row_number().over(W.partitionBy(by).orderBy(F.col(c).desc(), F.col(tie)))
    n = F.count("*").over(W.partitionBy(by))
    k = F.greatest(F.lit(1), F.bround(n * share))
    marked = df.select((rank("actual") <= k).alias("hot"), (rank("predicted") <= k).alias("called"))
    c = marked.agg(F.count_if(F.col("hot") & F.col("called")).alias("hits"), F.count_if("called").alias("called"), F.count_if("hot").alias("hot"))
    p, r = F.col("hits") / F.nullif(F.col("called"), F.lit(0)), F.col("hits") / F.nullif(F.col("hot"), F.lit(0))
    return c.select("hits", "called", "hot", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0)), 6).alias("f1"))


def skill(mae: Column, naive: Column) -> Column:
    return 1 - mae / F.nullif(naive, F.lit(0))


def verdicts(steps: DataFrame, margin: float = 0.05) -> DataFrame:
    """Of steps(step, target, mae): the gain of each step over the one before in per cent, per target and as a mean, and what it says of the added family."""
    before = F.lag("mae").over(W.partitionBy("target").orderBy("step"))
    gains = steps.withColumn("gain_pct", 100 * (before - F.col("mae")) / before)
    mean = F.avg("gain_pct").over(W.partitionBy("step"))
    word = F.when(mean.isNull(), F.lit(None).cast("string")).when(mean > margin, "HELPS").when(mean > -margin, "no effect").otherwise("HURTS")
    return gains.select("step", "target", F.round("mae", 6).alias("mae"), F.round("gain_pct", 3).alias("gain_pct"), F.round(mean, 3).alias("mean_gain_pct"), word.alias("verdict"))
