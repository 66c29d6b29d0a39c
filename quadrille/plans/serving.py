"""Forecast serving as functions over DataFrames.

A forecast time is the end of the last bin that is known: the features are those of the bin before it, and horizon h is the
h-th bin from that bin on."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.functions import explain, text, timeutil
from quadrille.operators import inventory, models, routing, spatial
from quadrille.operators import panel as P

SEASONS = {"seasonal_naive_same_day": 96, "seasonal_naive_same_week": 672}
KINDS = {"pickup": "pickups", "dropoff": "dropoffs"}
FITTED = "boosted_trees"
OUTPUT = ["region_id", "forecast_time", "horizon", "predicted_pickups", "predicted_dropoffs", "projected_inventory", "shortage", "surplus", "cumulative_predicted_pickups", "cumulative_predicted_dropoffs", "capacity", "model", "inventory_estimated"]


class PredictionError(ValueError):
    """A request that can't be answered truthfully, with the reason."""


@dataclass
class Engine:
    """What forecasts are made from.

    panel(region_id, ts, pickups, dropoffs); features, with the columns of fitted models, by (region_id, ts); fitted models by (kind,
    horizon); inventory(region_id, day, capacity, start_inventory) by local day, if there is one."""

    panel: DataFrame
    features: DataFrame | None = None
    fitted: dict[tuple[str, int], object] = field(default_factory=dict)
    inventory: DataFrame | None = None
    zone: str = "America/New_York"
    minutes: int = 15

    def available_models(self) -> list[str]:
        """Names that `predict` can serve."""
        whole = self.features is not None and all((k, h) in self.fitted for k in KINDS for h in P.HORIZONS)
        return [FITTED] * whole + list(SEASONS)

    def known_bin(self, when: datetime, horizon: int, model: str) -> datetime:
        """The UTC start of the last known bin, of a request that can be served."""
        if horizon not in P.HORIZONS:
            raise PredictionError(f"unknown horizon {horizon}; known: {list(P.HORIZONS)}")
        if when.tzinfo is None:
            raise PredictionError("the forecast time must name its time zone")
        if model not in self.available_models():
            raise PredictionError(f"unknown model {model!r}; available: {', '.join(self.available_models())}")
        utc = when.astimezone(timezone.utc).replace(tzinfo=None)
        if not timeutil.on_grid(utc, self.minutes):
            raise PredictionError(f"{when} is not on the {self.minutes}-minute grid; the bin starts at {timeutil.snap(utc, self.minutes)} UTC")
        return utc - timedelta(minutes=self.minutes)

    def _per_horizon(self, at: datetime, horizon: int, model: str) -> DataFrame:
        """region_id and {kind}_{h} for all horizons up to the one asked for."""
        now = F.col("ts") == F.lit(at).cast("timestamp_ntz")
        steps = [h for h in P.HORIZONS if h <= horizon]
        if model in SEASONS:
            back = lambda c, h: F.greatest(F.coalesce(F.lag(c, SEASONS[model] - h).over(P.by_region()), F.lit(0)), F.lit(0)).cast("double")
            reach = F.col("ts") >= F.lit(at - timedelta(minutes=self.minutes * SEASONS[model])).cast("timestamp_ntz")  # a season is all that lags look at
            return self.panel.filter(reach & (F.col("ts") <= F.lit(at).cast("timestamp_ntz"))).select("region_id", "ts", *(back(c, h).alias(f"{k}_{h}") for k, c in KINDS.items() for h in steps)).filter(now).drop("ts")
        rows = self.features.filter(now)
        for k in KINDS:
            for h in steps:
                rows = models.score(self.fitted[k, h], rows).withColumnRenamed("predicted", f"{k}_{h}")
        return rows.select("region_id", *(f"{k}_{h}" for k in KINDS for h in steps))

    def predict(self, model: str, when: datetime, horizon: int, safety: float = 0.05, target: float = 0.50) -> DataFrame:
        """`OUTPUT` of every region at one time: the horizon's forecast, what is cumulated up to it, and the inventory that this leads to.

        Without an inventory of the local day its columns are null, and nothing is made up."""
        at = self.known_bin(when, horizon, model)
        rows = self._per_horizon(at, horizon, model)
        if not rows.limit(1).count():
            raise PredictionError(f"nothing is known of the bin {at} UTC before {when}")
        steps = [h for h in P.HORIZONS if h <= horizon]
        total = lambda k: sum((F.col(f"{k}_{h}") for h in steps), F.lit(0.0))
        day = timeutil.utc_to_local(F.lit(at).cast("timestamp_ntz"), self.zone)
        if self.inventory is None:
            rows = rows.withColumns({"capacity": F.lit(None).cast("double"), "start_inventory": F.lit(None).cast("double")})
        else:
            of_day = self.inventory.filter(F.col("day").cast("date") == F.to_date(day)).select("region_id", F.col("capacity").cast("double").alias("capacity"), F.col("start_inventory").cast("double").alias("start_inventory"))
            rows = rows.join(of_day, "region_id", "left")
        out = rows.withColumns({"cumulative_predicted_pickups": total("pickup"), "cumulative_predicted_dropoffs": total("dropoff"), "predicted_pickups": F.col(f"pickup_{horizon}"), "predicted_dropoffs": F.col(f"dropoff_{horizon}")})
        known = F.col("capacity").isNotNull()
        level = F.when(known, inventory.projected(F.col("start_inventory"), F.col("cumulative_predicted_pickups"), F.col("cumulative_predicted_dropoffs"), F.col("capacity")))
        low, high = inventory.shortage_surplus(F.col("projected_inventory"), F.col("capacity"), safety, target)
        out = out.withColumn("projected_inventory", level).withColumns({
            "shortage": F.when(known, low), "surplus": F.when(known, high), "forecast_time": F.lit(when.astimezone(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"),
            "horizon": F.lit(horizon), "model": F.lit(model), "inventory_estimated": F.max(known).over(W.partitionBy(F.lit(1)))})  # a row per region
        return out.select(*OUTPUT)

    def actuals(self, when: datetime, horizon: int) -> DataFrame:
        """What happened in the bin that the horizon stands for."""
        at = self.known_bin(when, horizon, next(iter(SEASONS))) + timedelta(minutes=self.minutes * horizon)
        return self.panel.filter(F.col("ts") == F.lit(at).cast("timestamp_ntz")).select("region_id", F.lit(horizon).alias("horizon"), "pickups", "dropoffs")

    def overview(self, model: str, when: datetime, top: int = 12) -> DataFrame:
        """The busiest regions of a forecast, with what is to be expected there."""
        rows = self.predict(model, when, 1).orderBy(F.desc("predicted_pickups"), "region_id").limit(top)
        p, q = F.col("predicted_pickups"), F.col("predicted_dropoffs")
        return rows.select("region_id", "predicted_pickups", "predicted_dropoffs", inventory.verdict(p, q).alias("verdict"), "shortage", "surplus")

    def compare_models(self, when: datetime, horizon: int) -> DataFrame:
        """The forecasts of all models that can be served."""
        out = None
        for m in self.available_models():
            rows = self.predict(m, when, horizon)
            out = rows if out is None else out.unionByName(rows)
        return out

    def explain(self, when: datetime, holidays: DataFrame) -> DataFrame:
        """What the forecasts of all regions at one time rest on (see `explain.drivers`)."""
        at = self.known_bin(when, 1, next(iter(SEASONS)))
        local = timeutil.utc_to_local(F.col("ts"), self.zone)
        cols = {"local": local, "recent": P.ewm("pickups", 4), "typical": F.coalesce(P.expanding_slot_mean("pickups", local, self.minutes), F.lit(0.0)), "last_week": F.coalesce(F.lag("pickups", 671).over(P.by_region()), F.lit(0))}
        rows = self.panel.select("region_id", "ts", *(c.alias(n) for n, c in cols.items())).filter(F.col("ts") == F.lit(at).cast("timestamp_ntz"))
        return explain.drivers(rows, holidays)


def station_forecast(regions: DataFrame, stations: DataFrame) -> DataFrame:
    """Forecasts of regions shared out to stations(station_id, region_id, pickup_share, dropoff_share, share_confidence, ...), with pressure and verdict."""
    rows = stations.join(regions.select("region_id", "horizon", F.col("predicted_pickups").alias("_p"), F.col("predicted_dropoffs").alias("_q")), "region_id")
    rows = rows.withColumns({"predicted_pickups": F.col("_p") * F.col("pickup_share"), "predicted_dropoffs": F.col("_q") * F.col("dropoff_share")}).drop("_p", "_q")
    p, q = F.col("predicted_pickups"), F.col("predicted_dropoffs")
    return rows.withColumns({"pressure": inventory.pressure(p, q), "verdict": inventory.verdict(p, q)})


def stations_near(stations: DataFrame, lat: float, lng: float, k: int = 5) -> DataFrame:
    """The k nearest stations(station_id, lat, lng, ...) to a point, nearest first: a top-k."""
    km = spatial.haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return stations.withColumn("distance_km", km).orderBy("distance_km", "station_id").limit(k)


def route_to_bike(forecast: DataFrame, lat: float, lng: float, edges: DataFrame, candidates: int = 8, prefer_available: bool = True, landmarks: DataFrame | None = None) -> dict:
    """The station worth walking to from a point, and the way: straight if it is one hop away, else over the graph of edges(u, v, km).

    forecast: station_id, lat, lng, predicted_pickups, predicted_dropoffs; `candidates` nearest ones are weighed."""
    near = stations_near(forecast, lat, lng, candidates)
    scored = routing.route_scores(near.select("station_id", F.col("distance_km").alias("km"), F.col("predicted_pickups").alias("pickups"), F.col("predicted_dropoffs").alias("dropoffs")), prefer_available)
    rows = scored.orderBy("score", "station_id").collect()  # `candidates` rows
    if not rows:
        raise PredictionError("no stations near that point")
    best, entry, path = rows[0], min(rows, key=lambda r: (r.walk_km, r.station_id)), [rows[0].station_id]
    if not best.direct:
        found = routing.path_between(edges, entry.station_id, best.station_id, landmarks)
        path = found[0] if found else [entry.station_id]
    places = {r.station_id: (r.lat, r.lng) for r in forecast.filter(F.col("station_id").isin(path)).select("station_id", "lat", "lng").collect()}  # of the path
    at, legs = (lat, lng), []
    for s in path:
        legs.append({"to": s, "metres": round(routing.km_between(at, places[s]) * 1000 * routing.DETOUR)})
        at = places[s]
    walk = sum(x["metres"] for x in legs)
    return {"station_id": best.station_id, "nearest": entry.station_id, "reached": path[-1] == best.station_id, "legs": legs, "metres": walk, "minutes": round(walk / routing.WALK_M_PER_MIN), "line": routing.line_string([(lat, lng), *(places[s] for s in path)])}


def regions_geojson(forecast: DataFrame, indexer) -> DataFrame:
    """(region_id, feature): each region's outline with its forecast; the indexer's `boundary` gives the ring."""
    props = {c: F.col(c) for c in ("region_id", "predicted_pickups", "predicted_dropoffs", "projected_inventory", "shortage", "surplus")}
    return forecast.select("region_id", text.polygon_geojson(indexer.boundary(F.col("region_id")), props).alias("feature"))

