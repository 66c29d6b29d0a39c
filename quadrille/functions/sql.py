"""The engine's functions by name in Spark SQL: cells, rings, bins, local time, distances, polylines, gaps.

All but one are SQL functions, which the optimiser puts into the plan as if they had been written out, so that nothing leaves
the JVM.  `bin_gaps` is a table function over a partitioned, ordered table: it sees one series at a time, row by row, and holds one row."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quadrille.session import ship

SCALARS = {
    "cell_of(lat DOUBLE, lng DOUBLE, step DOUBLE)": ("STRING", "concat_ws('_', CAST(floor(lat / step) AS STRING), CAST(floor(lng / step) AS STRING))"),
    "cell_lat(cell STRING, step DOUBLE)": ("DOUBLE", "(CAST(split(cell, '_')[0] AS DOUBLE) + 0.5D) * step"),
    "cell_lng(cell STRING, step DOUBLE)": ("DOUBLE", "(CAST(split(cell, '_')[1] AS DOUBLE) + 0.5D) * step"),
    "cell_ring(cell STRING, k INT)": ("ARRAY<STRING>", """flatten(transform(sequence(-k, k), i -> transform(sequence(-k, k), j -> concat_ws('_', CAST(CAST(split(cell, '_')[0] AS BIGINT) + i AS STRING), CAST(CAST(split(cell, '_')[1] AS BIGINT) + j AS STRING)))))"""),
    "bin_of(ts TIMESTAMP_NTZ, minutes INT)": ("TIMESTAMP_NTZ", "CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, minute(ts) DIV minutes * minutes, 0)"),
    "bins_between(first TIMESTAMP_NTZ, last TIMESTAMP_NTZ, minutes INT)": ("ARRAY<TIMESTAMP_NTZ>", "sequence(CAST(date_trunc('HOUR', first) AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, minute(first) DIV minutes * minutes, 0), CAST(date_trunc('HOUR', last) AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, minute(last) DIV minutes * minutes, 0), make_dt_interval(0, 0, minutes, 0))"),
    "local_time(ts TIMESTAMP_NTZ, zone STRING)": ("TIMESTAMP_NTZ", "CAST(from_utc_timestamp(CAST(ts AS TIMESTAMP), zone) AS TIMESTAMP_NTZ)"),
    "utc_time(ts TIMESTAMP_NTZ, zone STRING)": ("TIMESTAMP_NTZ", "CAST(to_utc_timestamp(CAST(ts AS TIMESTAMP), zone) AS TIMESTAMP_NTZ)"),
    "km_between(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE)": ("DOUBLE", "2 * 6371.0088D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2))))"),
    "polyline_points(line STRING)": ("ARRAY<STRUCT<lat: DOUBLE, lng: DOUBLE>>", r"""filter(transform(split(trim(regexp_replace(line, '\\s+', ' ')), ' '), p -> named_struct('lat', try_cast(get(split(p, ','), 0) AS DOUBLE), 'lng', try_cast(get(split(p, ','), 1) AS DOUBLE))), v -> v.lat IS NOT NULL AND v.lng IS NOT NULL)"""),
}


@udtf(returnType="series string, gap_start timestamp_ntz, gap_end timestamp_ntz, missing int")
class BinGaps:
    """Holes of a series: bin_gaps(TABLE(t) PARTITION BY series ORDER BY (ts), minutes) over rows whose first columns are a series' name and a bin's start."""

    def __init__(self):
        self.last = None

    def eval(self, row, minutes: int):
        series, ts = row[0], row[1]
        step = timedelta(minutes=minutes)
        if self.last is not None and ts - self.last > step:
            yield str(series), self.last + step, ts - step, int((ts - self.last) / step) - 1
        self.last = ts


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to the session's SQL, for this session only."""
    ship(spark)
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("bin_gaps", BinGaps)
    return spark
