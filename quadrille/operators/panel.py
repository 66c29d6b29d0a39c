"""Dense region-by-bin panels, targets, lags, rolling and seasonal features.

Everything positional is valid only because the panel is dense.  All windows of one frame of features share
one exchange by region; the grid is built per region with `sequence`, so no cross join and no per-bin shuffle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.functions import timeutil

LAGS = (1, 2, 4, 8, 12, 24, 96, 192, 672)
HORIZONS = (1, 2, 3, 4)


def by_region():
    """Each region in time order (made on call: a window needs a live session)."""
    return W.partitionBy("region_id").orderBy("ts")



def counts(events: DataFrame, minutes: int = 15) -> DataFrame:
    """(region_id, ts, pickups, dropoffs) of the bins that have events(region_id, ts, is_pickup)."""
    return events.groupBy("region_id", timeutil.bin_start("ts", minutes).alias("ts")).agg(F.count_if("is_pickup").alias("pickups"), F.count_if(~F.col("is_pickup")).alias("dropoffs"))


def dense(events: DataFrame, regions: DataFrame, lo: datetime, hi: datetime, minutes: int = 15) -> DataFrame:
    """A row for every region and bin of [lo, hi), with zeros where nothing happened."""
    grid = regions.select("region_id", F.explode(timeutil.bins(lo, hi, minutes)).alias("ts"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return grid.join(counts(events, minutes), ["region_id", "ts"], "left").select("region_id", "ts", zero("pickups"), zero("dropoffs"))


def active_regions(events: DataFrame, min_trips: int, min_days: int) -> DataFrame:
    """Activity of each region that reaches both thresholds."""
    agg = events.groupBy("region_id").agg(
        F.count("*").alias("total_trips"), F.count_if("is_pickup").alias("total_pickups"), F.count_if(~F.col("is_pickup")).alias("total_dropoffs"),
        F.countDistinct(F.to_date("ts")).alias("active_days"), F.countDistinct("station_id").alias("station_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return agg.filter((F.col("total_trips") >= min_trips) & (F.col("active_days") >= min_days))


def scaled_threshold(value: float, days: float, full_days: float) -> int:
    """A threshold for a part of the window: rounded half to even, at least 1."""
    return max(1, round(value * days / full_days))


def targets(names=("pickups", "dropoffs"), horizons=HORIZONS) -> dict[str, Column]:
    """The value h bins ahead; null, never 0, past the end."""
    return {f"{n[:-1]}_h{h}": F.lead(n, h).over(by_region()) for n in names for h in horizons}


def lags(names=("pickups", "dropoffs"), steps=LAGS) -> dict[str, Column]:
    return {f"{n}_lag{k}": F.lag(n, k).over(by_region()) for n in names for k in steps}


def warm(df: DataFrame, steps: int) -> DataFrame:
    """Rows with at least `steps` predecessors in their region."""
    return df.withColumn("_n", F.row_number().over(by_region())).filter(F.col("_n") > steps).drop("_n")


def frame(w: int):
    return by_region().rowsBetween(1 - w, 0)


def rolling(name: str, windows) -> dict[str, Column]:
    """Mean (from 1 row), sample deviation (from 2) and sum over the last w rows."""
    out: dict[str, Column] = {}
    for w in windows:
        out[f"{name}_mean{w}"] = F.avg(name).over(frame(w))
        out[f"{name}_std{w}"] = F.stddev_samp(name).over(frame(w))
        out[f"{name}_sum{w}"] = F.sum(name).over(frame(w))
    return out


def seasonal_slots(name: str, seasons=(96, 672), horizons=HORIZONS) -> dict[str, Column]:
    """The value one season before the target of each horizon."""
    return {f"{name}_season{s}_h{h}": F.lag(name, s - h).over(by_region()) for s in seasons for h in horizons}


def expanding_slot_mean(name: str, local: Column, minutes: int = 15, least: int = 3) -> Column:
    """Mean of strictly earlier values in the region's same weekday and slot of the local clock; null until `least` of them."""
    w = W.partitionBy("region_id", F.extract(F.lit("dayofweek_iso"), local), timeutil.slot_of_day(local, minutes)).orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    return F.when(F.count(name).over(w) >= least, F.avg(name).over(w))


def ewm(name: str, span: int, reach: int = 64) -> Column:
    """Adjusted exponentially weighted mean over the last `reach` rows (weights below 1e-14 beyond, for spans up to 4)."""
    keep = 1 - 2 / (span + 1)
    past = F.collect_list(F.col(name).cast("double")).over(frame(reach))
    at = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    total = F.aggregate(past, at, lambda a, x: F.struct((a["s"] * keep + x).alias("s"), (a["w"] * keep + 1).alias("w")))
    return total["s"] / total["w"]


def ewm_exact(panel: DataFrame, name: str, spans) -> DataFrame:
    """Adjusted exponentially weighted means of any span, one region's series at a time."""
    from quadrille.session import ship

    ship(panel.sparkSession)
    cols = [f"{name}_ewm{s}" for s in spans]

    def run(pdf):
        pdf = pdf.sort_values("ts")
        for s, c in zip(spans, cols):
            pdf[c] = pdf[name].astype(float).ewm(span=s, adjust=True, ignore_na=True).mean()
        return pdf[["region_id", "ts", *cols]]

    return panel.select("region_id", "ts", name).groupBy("region_id").applyInPandas(run, "region_id string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))


def trend(a: str = "pickups", b: str = "dropoffs") -> dict[str, Column]:
    """Differences, hour over hour, net flow and the smoothed ratio of the last hour's flows."""
    out = {f"{a}_delta{s}": F.col(a) - F.lag(a, s).over(by_region()) for s in (1, 2, 4)}
    net = F.col(b) - F.col(a)
    out[f"{a}_hour_change"] = F.avg(a).over(frame(4)) - F.avg(a).over(by_region().rowsBetween(-7, -4))
    out["net_flow"] = net
    out["net_flow_lag1"] = F.lag(net, 1).over(by_region())
    out["net_sum4"] = F.sum(net).over(frame(4))
    out["net_sum24"] = F.sum(net).over(frame(24))
    out["flow_ratio"] = (F.sum(b).over(frame(4)) + 1) / (F.sum(a).over(frame(4)) + 1)
    return out
