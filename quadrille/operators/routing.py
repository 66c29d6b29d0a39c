"""Walking graphs and shortest paths."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.storage import discard, materialise

DETOUR, WALK_M_PER_MIN, DIRECT_KM, TOO_FAR_KM = 1.30, 80.0, 0.75, 2.0


def street_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, km), u < v: consecutive nodes of ways(way_id, node_ids), with known coordinates, once each."""
    from quadrille.operators.spatial import haversine_km

    flat = ways.select("way_id", F.posexplode("node_ids").alias("i", "node"))
    pairs = flat.withColumn("next", F.lead("node").over(W.partitionBy("way_id").orderBy("i"))).filter("next is not null and next <> node")
    e = pairs.select(F.least("node", "next").alias("u"), F.greatest("node", "next").alias("v")).distinct()
    n = nodes.select("id", "lat", "lng")
    j = e.join(n.toDF("u", "a", "b"), "u").join(n.toDF("v", "c", "d"), "v")
    return j.select("u", "v", haversine_km("a", "b", "c", "d").alias("km"))


def shortest_paths(edges: DataFrame, source: str, goal: str | None = None) -> DataFrame:
    """(node, km): least distance from `source` over edges(u, v, km) in any number of hops, to every node that it reaches.

    Given a goal, nodes that are farther than the goal are not gone on from, so that only distances up to the goal's are sure to be least.

    Each round relaxes only the nodes that came nearer in the last one, and is a table of its own, so that plans don't
    grow; it ends when no distance changes."""
    spark = edges.sparkSession
    both = materialise(edges.select("u", "v", "km").union(edges.select("v", "u", "km")).groupBy("u", "v").agg(F.min("km").alias("km")), "edges")
    best = materialise(spark.createDataFrame([(source, 0.0, True)], "node string, km double, moved boolean"), "paths")
    reach = None
    while best.filter("moved").limit(1).count():
        if goal is not None and (found := best.filter(F.col("node") == goal).first()):
            reach = found.km
        front = best.filter("moved") if reach is None else best.filter("moved").filter(F.col("km") < reach)
        step = front.withColumnRenamed("km", "_from").join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node"), (F.col("_from") + F.col("km")).alias("_new"))
        near = step.groupBy("node").agg(F.min("_new").alias("_new"))
        closer = F.col("_new").isNotNull() & (F.col("km").isNull() | (F.col("_new") < F.col("km")))
        old, best = best, materialise(best.drop("moved").join(near, "node", "full").select("node", F.when(closer, F.col("_new")).otherwise(F.col("km")).alias("km"), closer.alias("moved")), "paths")
        discard(old)
    discard(both)
    out = best.select("node", "km")
    out._table_path = best._table_path
    return out


def km_between(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q, x, y = map(math.radians, (*a, *b))
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, math.sin((x - p) / 2) ** 2 + math.cos(p) * math.cos(x) * math.sin((y - q) / 2) ** 2)))


class Graph:
    """An undirected graph of one request, small enough for one machine."""

    def __init__(self, places: dict, edges):
        self.places, self.links = places, {n: {} for n in places}
        for u, v, km in edges:
            if u in places and v in places and u != v:
                self.links[u][v] = min(km, self.links[u].get(v, math.inf))
                self.links[v][u] = self.links[u][v]

    def snap(self, lat: float, lng: float):
        """The nearest node that has an edge."""
        return min((n for n in self.places if self.links[n]), key=lambda n: (km_between(self.places[n], (lat, lng)), n))

    def path(self, start, goal) -> tuple[list, float] | None:
        """A shortest path by best-first search with the straight distance as lower bound; None if there is none."""
        bound = lambda n: km_between(self.places[n], self.places[goal])
        open_, best, back = [(bound(start), 0.0, start)], {start: 0.0}, {}
        while open_:
            _, so_far, n = heapq.heappop(open_)
            if n == goal:
                route = [n]
                while n in back:
                    n = back[n]
                    route.append(n)
                return route[::-1], so_far
            if so_far > best[n]:
                continue
            for m, km in self.links[n].items():
                if so_far + km < best.get(m, math.inf):
                    best[m], back[m] = so_far + km, n
                    heapq.heappush(open_, (so_far + km + bound(m), so_far + km, m))
        return None


MOST_EDGES = 200_000  # that one machine searches at once
NEAR = 1e-9  # of a length, for the rounding of sums


def landmark_distances(edges: DataFrame, k: int = 4) -> DataFrame:
    """(node, d): distances from k landmarks over edges(u, v, km), null where there is no way.

    The first landmark is the least node; each further one is the node farthest from those before it, of all parts of the
    graph the ones not reached yet first.  Made once for a graph, it bounds every search."""
    e = edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.col("km").cast("double").alias("km"))
    nodes = materialise(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "nodes")
    table = nodes.select("node", F.array().cast("array<double>").alias("d"))
    for _ in range(k):
        away = F.array_min("d")  # null before the first landmark and for what none has reached
        found = table.orderBy(away.desc_nulls_first(), "node").first()
        if found is None or (found.d and min((x for x in found.d if x is not None), default=1.0) == 0.0):
            break
        old, from_it = table, shortest_paths(e, found.node)
        table = materialise(table.join(from_it, "node", "left").select("node", F.array_append("d", F.col("km")).alias("d")), "landmarks")
        if hasattr(old, "_table_path"):
            discard(old)
        discard(from_it)
    return table


def corridor(edges: DataFrame, landmarks: DataFrame, start: str, goal: str) -> DataFrame:
    """The edges whose ends can lie on a shortest path, by the triangle inequality over landmark distances: all edges if these give no bound."""
    ends = {r.node: r.d for r in landmarks.filter(F.col("node").isin(start, goal)).collect()}
    if len(ends) < len({start, goal}):
        return edges.limit(0)
    a, b = ends[start], ends[goal]
    if any((x is None) != (y is None) for x, y in zip(a, b)):
        return edges.limit(0)  # in different parts of the graph
    known = [i for i, x in enumerate(a) if x is not None]
    if not known:
        return edges
    longest = min(a[i] + b[i] for i in known) * (1 + NEAR)
    low = lambda d: F.greatest(F.lit(0.0), *(F.abs(F.get("d", F.lit(i)) - d[i]) for i in known))
    inside = landmarks.filter(low(a) + low(b) <= longest).select("node")
    ids = lambda c: F.col(c).cast("string")
    return edges.join(inside, ids("u") == F.col("node"), "left_semi").join(inside, ids("v") == F.col("node"), "left_semi")


def path_between(edges: DataFrame, start, goal, landmarks: DataFrame | None = None, places: dict | None = None) -> tuple[list, float] | None:
    """A shortest path (nodes, km) over edges(u, v, km) without directions; None if there is none.

    Landmark distances leave a corridor of the graph.  Up to `MOST_EDGES` of them are searched on the driver; of more, distances from both ends are
    relaxed on the executors, and only the edges of shortest paths come to the driver."""
    s, g = str(start), str(goal)
    part = edges.select("u", "v", "km") if landmarks is None else corridor(edges.select("u", "v", "km"), landmarks, s, g)
    if part.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        e = part.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.col("km").cast("double").alias("km"))
        there = shortest_paths(e, s, g)
        found = there.filter(F.col("node") == g).first()
        if found is None:
            discard(there)
            return None
        back = shortest_paths(e, g, s)
        on = materialise(there.join(back.withColumnRenamed("km", "left"), "node").filter(F.col("km") + F.col("left") <= found.km * (1 + NEAR)).select("node"), "on-the-way")
        discard(there, back)
        part = part.join(on, F.col("u").cast("string") == F.col("node"), "left_semi").join(on, F.col("v").cast("string") == F.col("node"), "left_semi")
    rows = [(r.u, r.v, r.km) for r in part.collect()]
    nodes = {n for u, v, _ in rows for n in (u, v)} | {start, goal}
    return Graph({n: (places or {}).get(n, (0.0, 0.0)) for n in nodes} if places and nodes <= set(places) else dict.fromkeys(nodes, (0.0, 0.0)), rows).path(start, goal)


class StreetError(ValueError):
    """A street network that can't be used, with the reason."""


def walk_route(edges: DataFrame, nodes: DataFrame, origin: tuple[float, float], goal: tuple[float, float], landmarks: DataFrame | None = None) -> dict:
    """A way along streets between two points, over edges(u, v, km) and nodes(id, lat, lng).

    Says how far each end lies from its street; real street lengths need no detour factor.  `landmarks` (see `landmark_distances`) keep the search of a large network to a corridor."""
    from quadrille.operators.spatial import haversine_km

    if not edges.limit(1).count():
        raise StreetError("no walkable streets in that area")
    ends = edges.filter("u <> v").select(F.col("u").alias("id")).union(edges.filter("u <> v").select("v")).distinct()
    there = nodes.join(ends, "id", "left_semi")
    snap = lambda p: there.orderBy(haversine_km(F.lit(p[0]), F.lit(p[1]), F.col("lat"), F.col("lng")), "id").select("id").first()
    a, b = snap(origin), snap(goal)
    if a is None or a == b:
        raise StreetError("both points lie at the same street node")
    found = path_between(edges, a.id, b.id, landmarks)
    if found is None:
        raise StreetError("no walkable path between those points")
    places = {r.id: (r.lat, r.lng) for r in nodes.filter(F.col("id").isin(found[0])).collect()}  # of the path
    gaps = km_between(origin, places[a.id]) * 1000, km_between(goal, places[b.id]) * 1000
    return {"metres": found[1] * 1000 + sum(gaps), "street_metres": found[1] * 1000, "snap_metres": tuple(map(round, gaps)), "nodes": len(found[0]), "line": line_string([origin, *(places[n] for n in found[0]), goal])}


def route_scores(candidates: DataFrame, prefer_available: bool = True) -> DataFrame:
    """Order stations(station_id, km, pickups, dropoffs) for a walker: the detoured walk and, if wanted, the pressure penalty; the first by score is the choice.

    `direct` says whether the walk is one hop; beyond it the way leads over other stations."""
    from quadrille.operators.inventory import pressure_penalty_km

    penalty = pressure_penalty_km(F.col("pickups"), F.col("dropoffs")) if prefer_available else F.lit(0.0)
    c = candidates.withColumn("walk_km", F.col("km") * DETOUR).withColumn("penalty_km", penalty)
    return c.withColumns({"minutes": F.col("walk_km") * 1000 / WALK_M_PER_MIN, "too_far": F.col("walk_km") > TOO_FAR_KM, "direct": F.col("km") <= DIRECT_KM, "score": F.col("walk_km") + F.col("penalty_km")})


def line_string(points: list[tuple[float, float]]) -> dict:
    return {"type": "LineString", "coordinates": [[round(lng, 6), round(lat, 6)] for lat, lng in points]}
