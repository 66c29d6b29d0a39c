"""Sinks: partitioned and sorted Parquet, reports and tensors in long form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZSTD = {"compression": "zstd"}


def write_months(df: DataFrame, path: str, mode: str = "append") -> None:
    """One directory a month, `unknown` where it is null; a task writes to as many files as it has months."""
    df.withColumn("month", F.coalesce("month", F.lit("unknown"))).write.options(**ZSTD).mode(mode).partitionBy("month").parquet(path)


def write_sorted(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Globally sorted files by range partitions: file order is value order, and no task sorts more than its range."""
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.options(**ZSTD).mode(mode).parquet(path)


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Panel files by month, sorted by region and time within each."""
    months = df.withColumn("month", F.date_format("ts", "yyyyMM"))
    months.repartition("month", "region_id").sortWithinPartitions("month", "region_id", "ts").write.options(**ZSTD).mode(mode).partitionBy("month").parquet(path)


def file_order(df: DataFrame, column: str) -> DataFrame:
    """Least and largest value of each file: sorted files don't overlap."""
    return df.select(F.col("_metadata.file_name").alias("file"), column).groupBy("file").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n_rows"))


def reconcile(written: DataFrame, key: str) -> dict:
    """Rows and distinct keys of what was written, for comparison with what was meant."""
    r = written.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys")).first()
    return {"rows": r["rows"], "keys": r["keys"]}


def write_report(rows: DataFrame, path: str) -> None:
    """A small metrics table as JSON on the driver's side."""
    with open(path, "w") as f:
        json.dump([r.asDict(recursive=True) for r in rows.collect()], f, indent=2, default=str)


def tensor_long(panel: DataFrame, scaling: DataFrame) -> DataFrame:
    """Scaled demand per time as an array over regions in id order: a time-by-region tensor in rows."""
    s = panel.join(scaling, "region_id").withColumn("v", (F.col("pickups") - F.col("mean")) / F.nullif("std", F.lit(0.0)))
    return s.groupBy("ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("region_id", "v"))), lambda x: x["v"]).alias("demand"))
