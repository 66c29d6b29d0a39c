"""Profiles of raw tables."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.storage import discard, materialise


def null_profile(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows, distinct keys, repeated rows and nulls of each column."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("distinct_keys"), (F.count(key) - F.countDistinct(key)).alias("duplicate_rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def quantiles(df: DataFrame, column: str, points: dict[str, float], digits: int = 6) -> DataFrame:
    """Least, largest, mean and exact interpolated quantiles; all null for a column without values.

    Values are counted, dealt in ranges and cumulated range by range, so that no task holds all distinct values."""
    spark = df.sparkSession
    v = F.col("v")
    counted = materialise(df.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n")).repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = counted.groupBy("part").agg(F.sum("n").alias("of_part"), F.sum(v * F.col("n")).alias("weight"), F.min("v").alias("least"), F.max("v").alias("most"))
    whole = parts.agg(F.sum("of_part"), F.min("least"), F.max("most"), F.sum("weight")).first()
    n = whole[0] or 0
    names = ", ".join(f"{c} double" for c in ("least", "most", "mean", *points))
    if not n:
        return spark.createDataFrame([(None,) * (3 + len(points))], names)
    before = parts.select("part", (F.sum("of_part").over(W.orderBy("part")) - F.col("of_part")).alias("before"))  # a row per range
    last = F.sum("n").over(W.partitionBy("part").orderBy("v")) + F.col("before")
    placed = counted.join(F.broadcast(before), "part").withColumn("last", last)
    at = {name: (q * (n - 1)) for name, q in points.items()}
    wanted = F.array(*(F.lit(int(k)).cast("long") for h in at.values() for k in (math.floor(h), math.ceil(h))))
    hit = F.filter(F.array_distinct(wanted), lambda k: (k < F.col("last")) & (k >= F.col("last") - F.col("n")))
    value = {r.k: r.v for r in placed.select(F.explode(hit).alias("k"), "v").collect()}  # two rows a point at most
    discard(counted)
    mid = lambda h: value[math.floor(h)] + (value[math.ceil(h)] - value[math.floor(h)]) * (h - math.floor(h))
    row = (whole[1], whole[2], whole[3] / n, *map(mid, at.values()))
    return spark.createDataFrame([row], names).select("least", "most", *(F.round(c, digits).alias(c) for c in ("mean", *points)))


def missing_days(days: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """Calendar days of [first, last] that `column` lacks."""
    spark = days.sparkSession
    every = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return every.join(days.select(F.to_date(column).alias("day")).distinct(), "day", "left_anti")


def mode(column: str) -> Column:
    """The most frequent value; the least of equally frequent ones."""
    return F.mode(column, True)


def markdown(rows: list[dict]) -> str:
    """A report table."""
    if not rows:
        return "_no rows_"
    text = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:,.4f}" if isinstance(v, float) else str(v)
    head = list(rows[0])
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(text(r[c]) for c in head) + " |" for r in rows)])
