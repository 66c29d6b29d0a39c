"""Streaming counterparts: incremental ingest and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def region_bins(events: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Counts per region and bin; a bin closes once the watermark has passed it."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy("region_id", w).agg(F.count_if("is_pickup").alias("pickups"), F.count_if(~F.col("is_pickup")).alias("dropoffs")).select("region_id", F.col("window.start").alias("ts"), "pickups", "dropoffs")


def distinct_rides(events: DataFrame, key: str = "ride_id", late: str = "1 hour") -> DataFrame:
    """Repeated rides within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def ingest_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all files that haven't been read yet, then stop: resumable ingest without a manifest."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
