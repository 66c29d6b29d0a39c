"""Rule-based cleaning: each removed row is charged to the first rule it breaks, and the counts reconcile."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.functions import timeutil

Rules = list[tuple[str, Column]]


def trip_rules(first: date, last: date, tz: str, box: tuple[float, float, float, float], least_s: int = 60, most_s: int = 86_400) -> Rules:
    """Ordered trip rules; `first`..`last` are local dates, box is south, west, north, east."""
    s, w, n, e = box
    day = F.to_date(timeutil.utc_to_local(F.col("started_at"), tz))
    out = lambda lat, lng: ~F.col(lat).between(s, n) | ~F.col(lng).between(w, e)
    seconds = F.col("ride_duration")
    return [
        ("null_ride_id", F.col("ride_id").isNull()), ("null_timestamp", F.col("started_at").isNull() | F.col("ended_at").isNull()),
        ("outside_project_window", ~day.between(F.lit(first), F.lit(last))), ("end_before_start", F.col("ended_at") <= F.col("started_at")),
        ("duration_too_short", seconds < least_s), ("duration_too_long", seconds > most_s),
        ("missing_coords", F.col("start_lat").isNull() | F.col("start_lng").isNull() | F.col("end_lat").isNull() | F.col("end_lng").isNull()),
        ("coords_out_of_bbox", out("start_lat", "start_lng") | out("end_lat", "end_lng"))]


def traffic_rules(first: date, last: date, bad_status: str = "-101", speed: tuple[float, float] = (0.1, 100.0)) -> Rules:
    return [
        ("null_timestamp", F.col("data_as_of").isNull()), ("null_link_id", F.col("link_id").isNull()),
        ("outside_project_window", ~F.to_date("data_as_of").between(F.lit(first), F.lit(last))), ("invalid_status", F.col("status") == bad_status),
        ("speed_out_of_range", ~F.col("speed").between(*speed)), ("travel_time_nonpositive", F.col("travel_time") <= 0)]


def label(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds drop_reason: the first rule whose predicate is true (null counts as not broken), else null."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return df.withColumn("drop_reason", reason)


def waterfall(labelled: DataFrame, rules: Rules, before: list[str] = ()) -> DataFrame:
    """step, name, n, pct: what was removed before the rules, every rule in order (zeros included), the total removed and the kept.

    One aggregation of the labelled rows; `before` names reasons that were charged before the rules (`mark_repeats`)."""
    got = labelled.groupBy(F.coalesce("drop_reason", F.lit("KEPT")).alias("name")).agg(F.count("*").alias("n"))
    names = [*before, *(n for n, _ in rules)]
    counts = F.map_from_entries(F.collect_list(F.struct("name", "n")))  # one entry a reason
    n = lambda c, name: F.coalesce(F.try_element_at(c, F.lit(name)), F.lit(0)).cast("long")
    c = F.col("c")
    removed = F.aggregate(F.array(*(n(c, x) for x in names)), F.lit(0).cast("long"), lambda a, x: a + x)
    steps = [(i, x, n(c, x)) for i, x in enumerate(names)] + [(len(names), "KEPT", n(c, "KEPT")), (len(names) + 1, "TOTAL REMOVED", F.col("removed"))]
    rows = got.agg(counts.alias("c")).withColumn("removed", removed).withColumn("total", F.col("removed") + n(c, "KEPT"))
    rows = rows.select("total", F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("step"), F.lit(x).alias("name"), v.alias("n")) for i, x, v in steps))))
    return rows.select("step", "name", "n", F.round(100 * F.col("n") / F.nullif("total", F.lit(0)), 4).alias("pct"))


def mark_repeats(df: DataFrame, keys: list[str], order: list[Column], rules: Rules, reason: str) -> DataFrame:
    """Labels with drop_reason: rows whose key stands before them in `order` are charged to `reason`, the others to the first rule they break.

    Rows with a null key are no repeats."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    w = W.partitionBy(*keys).orderBy(*order)
    later = df.filter(known).withColumn("_later", F.row_number().over(w) > 1).unionByName(df.filter(~known).withColumn("_later", F.lit(False)))
    return label(later, [(reason, F.col("_later")), *rules]).drop("_later")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`; rows with a null key all stay."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    w = W.partitionBy(*keys).orderBy(*order)
    one = df.filter(known).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    return one.unionByName(df.filter(~known))


def duplicates_removed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows above one per key, over repeated keys."""
    many = df.dropna(subset=keys).groupBy(*keys).count().filter("count > 1")
    return many.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("removed"), F.count("*").alias("repeated_keys"))


def with_flags(df: DataFrame) -> DataFrame:
    """Properties that are kept as flags, not reasons to drop."""
    a, b = F.col("start_station_id"), F.col("end_station_id")
    return df.withColumn("missing_station_id", a.isNull() | b.isNull()).withColumn("is_round_trip", F.coalesce(a == b, F.lit(False)))


def sortedness(df: DataFrame, order: str, column: str, part: Column | None = None) -> DataFrame:
    """Rows and inversions (a value below its predecessor) when read by the distinct values of `order`.

    Parts (files, or value ranges of `order` by a whole-number expression) are compared inside by themselves, and their
    ends with each other: the only unpartitioned window is over one row a part."""
    part = part if part is not None else F.floor(F.col(order) / 65536).cast("long")
    rows = df.select(F.col(order).alias("_o"), F.col(column).alias("_v"), part.alias("_p"))
    inner = rows.withColumn("_b", F.lag("_v").over(W.partitionBy("_p").orderBy("_o"))).groupBy("_p").agg(
        F.count("*").alias("n"), F.count_if(F.col("_v") < F.col("_b")).alias("bad"), F.min_by("_v", "_o").alias("head"), F.max_by("_v", "_o").alias("tail"))
    ends = inner.withColumn("_b", F.lag("tail").over(W.orderBy("_p")))
    return ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("bad") + (F.coalesce(F.col("head") < F.col("_b"), F.lit(False))).cast("long")), F.lit(0)).alias("inversions"))
