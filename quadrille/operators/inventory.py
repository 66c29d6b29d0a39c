"""Station inventories: daily flow, capacity, feasible start, simulation and rebalancing."""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.session import ship


def daily_flow(moves: DataFrame) -> DataFrame:
    """Per station and day of moves(station_id, day, ts, tie, delta): range of the running sum, trips and its end."""
    order = [F.col("ts"), F.col("tie")]
    run = F.sum("delta").over(W.partitionBy("station_id", "day").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    r = moves.withColumn("run", run)
    return r.groupBy("station_id", "day").agg(
        F.min("run").alias("min_flow"), F.max("run").alias("max_flow"), (F.max("run") - F.min("run")).alias("flow_range"), F.count("*").alias("day_trips"), F.max_by("run", F.struct(*order)).alias("end_flow"))


def nearest_quantile(column: str, q: float) -> Column:
    """The element at round(q * (n - 1)) of the sorted values, halves up: a quantile that is an observed value."""
    return F.element_at(F.array_sort(F.collect_list(column)), (F.floor(q * (F.count(column) - 1) + 0.5) + 1).cast("int"))


def capacity(flow: DataFrame, q: float = 0.95, least: int = 8, days: int = 30, deciles: int = 10) -> DataFrame:
    """Per station: the q-quantile of the daily range, rounded up, at least `least`.

    Stations observed on fewer than `days` days take the median capacity (whole docks) of the well observed ones in their decile by trips instead."""
    raw = flow.groupBy("station_id").agg(nearest_quantile("flow_range", q).alias("raw"), F.count("*").alias("observed_days"), F.sum("day_trips").alias("total_trips"))
    own = raw.withColumn("own", F.greatest(F.ceil("raw"), F.lit(least)).cast("long"))
    edges = own.agg(F.percentile("total_trips", [i / deciles for i in range(1, deciles)]).alias("edges"))
    placed = own.crossJoin(F.broadcast(edges)).withColumn("decile", F.size(F.filter("edges", lambda e: e < F.col("total_trips"))).cast("long")).drop("edges")
    middle = placed.filter(F.col("observed_days") >= days).groupBy("decile").agg(F.median("own").alias("middle"))
    few = F.col("observed_days") < days
    out = placed.join(F.broadcast(middle), "decile", "left")
    return out.select(
        "station_id", "observed_days", "total_trips", "decile", F.when(few & F.col("middle").isNotNull(), F.floor("middle").cast("long")).otherwise(F.col("own")).alias("capacity"),
        F.when(few, "volume_decile_median").otherwise("flow_q95").alias("capacity_source"))


def start_inventory(low: Column, high: Column, cap: Column) -> tuple[Column, Column]:
    """The start nearest to half of cap that keeps start + [low, high] in [0, cap], and 0; on days where none does, the
    best of three candidates (-low, cap - high, half of cap) by overshoot and a thousandth of the distance to half, and its overshoot."""
    low, high, cap = (c.cast("double") for c in (low, high, cap))
    clip = lambda c, a, b: F.least(F.greatest(c, a), b)
    none, half = F.lit(0.0), cap / 2
    floor, roof = F.greatest(none, -low), F.least(cap, cap - high)
    miss = lambda s: F.greatest(none, -(s + low)) + F.greatest(none, s + high - cap)
    options = [floor, roof, clip(half, none, cap)]
    best = F.array_min(F.array(*(F.struct((miss(s) + F.abs(s - half) * 1e-3).alias("cost"), F.lit(i).alias("i"), s.alias("s"), miss(s).alias("miss")) for i, s in enumerate(options))))
    fits = floor <= roof
    return F.when(fits, clip(half, floor, roof)).otherwise(clip(best["s"], none, cap)), F.when(fits, none).otherwise(best["miss"])


def projected(inventory: Column, pickups: Column, dropoffs: Column, cap: Column) -> Column:
    return F.least(F.greatest(inventory + dropoffs - pickups, F.lit(0)), cap)


def shortage_surplus(level: Column, cap: Column, safety: float, target: float) -> tuple[Column, Column]:
    """Bikes that are lacking to safety * cap, and bikes above target * cap."""
    return F.greatest(cap * safety - level, F.lit(0.0)), F.greatest(level - cap * target, F.lit(0.0))


QUIET = 1.0  # expected trips below which nothing is said about a place


def pressure(pickups: Column, dropoffs: Column) -> Column:
    """Net inflow over all trips, -1 (only departures) to 1 (only arrivals); null below `QUIET` trips."""
    total = pickups + dropoffs
    return F.when(total >= QUIET, (dropoffs - pickups) / total)


def verdict(pickups: Column, dropoffs: Column) -> Column:
    """Where a place is heading, by pressure."""
    p = pressure(pickups, dropoffs)
    return F.when(p.isNull(), "quiet").when(p <= -0.25, "draining").when(p <= -0.05, "tightening").when(p < 0.05, "balanced").when(p < 0.25, "filling").otherwise("crowded")


def pressure_penalty_km(pickups: Column, dropoffs: Column, metres: float = 550.0) -> Column:
    """Extra distance for a station that drains; half of the most for one that is quiet."""
    p = pressure(pickups, dropoffs)
    return F.when(p.isNull(), F.lit(0.5)).otherwise(F.least(F.greatest(-p, F.lit(0.0)), F.lit(1.0))) * (metres / 1000)


def shares(stations: DataFrame, least: int = 2000) -> DataFrame:
    """Each station's shares of its region's pickups and of its dropoffs, equal shares where a region has none, and how far they may be trusted."""
    w = W.partitionBy("region_id")

    def share(c):
        total = F.sum(c).over(w).cast("double")
        return F.when(total > 0, F.col(c) / total).otherwise(1 / F.count("*").over(w))

    trips = F.col("pickups") + F.col("dropoffs")
    return stations.withColumns({"pickup_share": share("pickups"), "dropoff_share": share("dropoffs"), "lifetime_trips": trips, "share_confidence": F.when(trips >= least, "high").otherwise("low")})


def simulate(steps: DataFrame, start: DataFrame) -> DataFrame:
    """Replay without moves: per region_id, what is served, unserved and overflows when steps(region_id, ts, pickups, dropoffs) meet start(region_id, inventory, capacity).

    A fold over each region's ordered steps; a step's pickups come before its dropoffs."""
    s = F.struct("ts", "pickups", "dropoffs")
    series = steps.groupBy("region_id").agg(F.array_sort(F.collect_list(s)).alias("steps")).join(start, "region_id")
    zero = F.struct(F.col("inventory").cast("long").alias("inv"), *(F.lit(0).cast("long").alias(n) for n in ("served", "unserved", "overflow", "empty", "full")))
    cap = F.col("capacity").cast("long")

    def step(a, x):
        out = F.least(x["pickups"], a["inv"])
        mid = a["inv"] - out
        into = F.least(x["dropoffs"], cap - mid)
        inv = mid + into
        return F.struct(inv.alias("inv"), (a["served"] + out).alias("served"), (a["unserved"] + x["pickups"] - out).alias("unserved"), (a["overflow"] + x["dropoffs"] - into).alias("overflow"),
                        (a["empty"] + (inv == 0).cast("long")).alias("empty"), (a["full"] + (inv == cap).cast("long")).alias("full"))

    r = series.withColumn("r", F.aggregate("steps", zero, step))
    return r.select("region_id", "capacity", F.col("r.inv").alias("end_inventory"), *(F.col(f"r.{n}").alias(n) for n in ("served", "unserved", "overflow", "empty", "full")), F.round(F.col("r.served") / F.nullif(F.col("r.served") + F.col("r.unserved"), F.lit(0)), 6).alias("service_level"))


MOVES, RADIUS_KM = 150, 3.0  # of one round


def plan_moves(shortage: np.ndarray, surplus: np.ndarray, stock: np.ndarray, cap: np.ndarray, km_from, most: int = MOVES, radius_km: float = RADIUS_KM) -> list[tuple[int, int, int, float]]:
    """One round of moves (source, destination, bikes, km) between places by number; km_from(i) gives the distances from i to all.

    Whole bikes go to the place that lacks most, from the nearest one in reach that has some to spare; half a bike or less
    is neither lack nor spare.  A move is held by the lack, by what the source can spare and holds, and by what fits.
    A source that can't give a whole bike then is out, as is a place with no source left in reach; each of these
    steps counts towards `most`, and ties go to the lesser number.

    Lacks are a heap.  What sources can spare only falls, so that each place goes through its sources once, nearest first."""
    lacks = [(-x, i) for i, x in enumerate(shortage.tolist()) if x > 0.5]
    heapq.heapify(lacks)
    spare = {i: x for i, x in enumerate(surplus.tolist()) if x > 0.5}
    held = stock.astype(float)
    near: dict[int, list[int]] = {}
    out: list[tuple[int, int, int, float]] = []
    for _ in range(most):
        if not lacks or not spare:
            break
        lack, to = -lacks[0][0], lacks[0][1]
        km = km_from(to)
        if to not in near:  # nearest last, to be taken from the end
            near[to] = sorted((i for i in spare if km[i] <= radius_km), key=lambda i: (km[i], i), reverse=True)
        while near[to] and near[to][-1] not in spare:
            near[to].pop()
        if not near[to]:
            heapq.heappop(lacks)
            continue
        source = near[to][-1]
        bikes = math.floor(min(lack, spare[source], held[source], cap[to] - held[to]))
        if bikes < 1:
            del spare[source]
            continue
        out.append((source, to, bikes, float(km[source])))
        held[source], held[to] = held[source] - bikes, held[to] + bikes
        if spare[source] - bikes > 0.5:
            spare[source] -= bikes
        else:
            del spare[source]
        heapq.heappop(lacks)
        if lack - bikes > 0.5:
            heapq.heappush(lacks, (bikes - lack, to))
    return out


def distances(lat: np.ndarray, lng: np.ndarray):
    """km_from(i) for `plan_moves`: a row at a time, kept once computed."""
    a, b = np.radians(lat), np.radians(lng)

    @functools.cache
    def km_from(i: int) -> np.ndarray:
        h = np.sin((a - a[i]) / 2) ** 2 + np.cos(a[i]) * np.cos(a) * np.sin((b - b[i]) / 2) ** 2
        return 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))

    return km_from


class _Replay:
    """The running state of one scenario."""

    def __init__(self, key: str, safety: float, rows):
        self.key, self.safety = key, safety
        self.place = {r: i for i, r in enumerate(rows["region_id"])}
        self.stock, self.cap = rows["inventory"].to_numpy(dtype=float), rows["capacity"].to_numpy(dtype=float)
        self.km = distances(rows["lat"].to_numpy(), rows["lng"].to_numpy())
        self.step = 0
        self.totals = dict.fromkeys(("served", "unserved", "overflow", "empty", "full", "bikes_moved", "moves"), 0)
        self.far = 0.0

    def advance(self, rows, every: int, target: float) -> None:
        """One bin: on every `every`-th the forecast decides moves, which take effect at once; then demand and returns."""
        at = rows["region_id"].map(self.place).to_numpy()
        col = lambda c: np.bincount(at, weights=rows[c].to_numpy(dtype=float), minlength=len(self.cap))
        t = self.totals
        if self.step % every == 0 and self.safety is not None:
            level = np.clip(self.stock + col("predicted_in") - col("predicted_out"), 0, self.cap)
            for source, to, n, km in plan_moves(np.maximum(self.safety * self.cap - level, 0), np.maximum(level - target * self.cap, 0), self.stock, self.cap, self.km):
                self.stock[[source, to]] += (-n, n)
                t["bikes_moved"], t["moves"], self.far = t["bikes_moved"] + n, t["moves"] + 1, self.far + round(km, 3)
        wanted, back = col("pickups"), col("dropoffs")
        out = np.minimum(wanted, self.stock)
        into = np.minimum(back, self.cap - self.stock + out)
        self.stock += into - out
        for name, n in (("served", out.sum()), ("unserved", (wanted - out).sum()), ("overflow", (back - into).sum()), ("empty", (self.stock <= 0).sum()), ("full", (self.stock >= self.cap).sum())):
            t[name] += int(n)
        self.step += 1

    def summary(self) -> tuple:
        t = self.totals
        demand = t["served"] + t["unserved"]
        return (self.key, self.safety, *t.values(), round(self.far, 1), t["served"] / demand if demand else None)


def strategies(steps: DataFrame, scenarios: list[tuple[str, str | None, float | None]], every: int = 4, target: float = 0.5) -> DataFrame:
    """Replay with rebalancing for each scenario (name, forecast, safety share): what is served, and what the moves gain over none.

    steps: region_id, ts, pickups, dropoffs, inventory, capacity, lat, lng and, per forecast, {forecast}_out and {forecast}_in.
    A scenario is a task; its bins stream by in time order, so that a task holds one bin and one number per region."""
    made = F.explode(F.array(*(F.struct(
        F.lit(name).alias("scenario"), F.lit(safety).cast("double").alias("safety"),
        *((F.col(f"{forecast}_{side}") if forecast else F.lit(0)).cast("double").alias(f"predicted_{side}") for side in ("out", "in"))) for name, forecast, safety in scenarios)))
    names = ["region_id", "ts", "pickups", "dropoffs", "inventory", "capacity", "lat", "lng"]
    rows = steps.select(*names, made.alias("s")).select(*names, "s.*")

    def run(frames):
        import pandas as pd

        state, rest, done = None, None, []
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            change = (pdf["scenario"] != pdf["scenario"].shift()) | (pdf["ts"] != pdf["ts"].shift())
            starts = np.flatnonzero(change.to_numpy())
            for a, b in zip(starts, starts[1:]):
                state = follow(state, pdf.iloc[a:b], done)
            rest = pdf.iloc[starts[-1] :] if len(starts) else None
        if rest is not None:
            state = follow(state, rest, done)
            done.append(state.summary())
        yield pd.DataFrame(done, columns=[c.split()[0] for c in TOTALS.split(", ")])

    def follow(state, step, done):
        if state is None or state.key != step["scenario"].iloc[0]:
            if state is not None:
                done.append(state.summary())
            safety = step["safety"].iloc[0]
            state = _Replay(step["scenario"].iloc[0], None if safety != safety or safety is None else float(safety), step)
        state.advance(step, every, target)
        return state

    ship(steps.sparkSession)
    out = rows.repartition("scenario").sortWithinPartitions("scenario", "ts", "region_id").mapInPandas(run, TOTALS)
    none = F.max(F.when(F.col("safety").isNull(), F.struct("service_level", "unserved"))).over(W.partitionBy(F.lit(1)))  # a row per scenario
    return out.withColumn("_none", none).select(
        "*", F.round(F.col("service_level") - F.col("_none.service_level"), 6).alias("service_level_gain"), (F.col("_none.unserved") - F.col("unserved")).alias("unserved_avoided")).drop("_none").withColumn("service_level", F.round("service_level", 6))


TOTALS = "scenario string, safety double, served long, unserved long, overflow long, empty long, full long, bikes_moved long, moves long, distance_km double, service_level double"
