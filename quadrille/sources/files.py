"""File sources: CSV with an explicit schema and several null tokens, incremental directories, Parquet datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions import timeutil

NULL_TOKENS = ("", "NULL", "null", "NA")
# The columns of a raw trip file, all text but the coordinates.
RAW_TRIP_COLUMNS = ("ride_id", "rideable_type", "started_at", "ended_at", "start_station_name", "start_station_id", "end_station_name", "end_station_id", "start_lat", "start_lng", "end_lat", "end_lng", "member_casual")
RAW_TRIPS = T.StructType([T.StructField(c, T.DoubleType() if c.endswith(("_lat", "_lng")) else T.StringType()) for c in RAW_TRIP_COLUMNS])


def read_csv(spark: SparkSession, path, schema: T.StructType = RAW_TRIPS, lenient: bool = False) -> DataFrame:
    """CSV with a header; ids stay text whatever they look like, and every null token becomes null.

    lenient drops malformed lines; otherwise what doesn't parse is null."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).options(header=True, mode="DROPMALFORMED" if lenient else "PERMISSIVE").csv(path)
    clean = lambda c: F.when(~F.trim(c).isin(*NULL_TOKENS), c)
    return raw.select(*(clean(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema))


def pending(spark: SparkSession, path: str, done: DataFrame | None) -> list[str]:
    """Files of a glob that a manifest(file) doesn't name yet.  The list is as long as the directory, not as the data."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    left = files if done is None else files.join(done.select("file"), "file", "left_anti")
    return sorted(r.file for r in left.collect())


def ingest(raw: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """Parsed times in UTC, the ride's seconds and its local month; rows without either time are dropped."""
    a, b = timeutil.parse_timestamp("started_at"), timeutil.parse_timestamp("ended_at")
    rows = raw.withColumn("_a", a).withColumn("_b", b).dropna(subset=["_a", "_b"])
    out = rows.withColumns({"started_at": timeutil.local_to_utc(F.col("_a"), tz), "ended_at": timeutil.local_to_utc(F.col("_b"), tz), "month": F.date_format("_a", "yyyyMM")})
    return out.withColumn("ride_duration", F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at"))).drop("_a", "_b")


def read_months(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """A dataset partitioned by month, without the partition column; a month filter prunes directories."""
    df = spark.read.parquet(path)
    if months is not None:
        df = df.filter(F.col("month").cast("string").isin(*months))
    return df.drop("month")


def empty_like(df: DataFrame) -> DataFrame:
    """No rows of a sibling's schema, for an optional table that is absent."""
    return df.sparkSession.createDataFrame([], df.schema)
