"""Exact k nearest places at any distance on the globe.

Places are packed into tiles by sort-tile-recursive cuts: slices by longitude, then tiles by latitude, each of about `TILE` distinct
coordinates, with a box around its places in space.  Each point is first compared with the tiles that are nearest to it and hold k
places; the k-th of them bounds what may still be nearer, and only tiles whose boxes come within that bound are searched.  Boxes
are over unit vectors, so that poles and the date line are like any other place.

No pairs of points and places are made but inside tiles, in blocks; a task streams points past one tile.  Points of a crowded
tile are dealt over several tasks, with a copy of the tile in each.  Tiles are `MOST_TILES` at most (they get larger beyond), so that
their boxes may be broadcast.  Of places at the very same coordinate only the k least ids can be among the k nearest of any
point; the others are left out before tiles are made, so that no tile is larger than its cut whatever the crowds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.operators.spatial import EARTH_KM
from quadrille.session import ship
from quadrille.storage import discard, materialise

TILE = 512
MOST_TILES = 1 << 16
CROWD = 20_000  # points that one task compares with a tile
PAIRS = 1 << 20  # distances at a time
SLACK = 1e-9  # of a bound, for rounding
FOUND = "id long, lat double, lng double, other long, km double"


def vectors(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def kilometres(lat: np.ndarray, lng: np.ndarray, lats: np.ndarray, lngs: np.ndarray) -> np.ndarray:
    """Great-circle distances of all points (rows) to all places (columns)."""
    a, c = np.radians(lat)[:, None], np.radians(lats)[None, :]
    h = np.sin(np.radians(lats[None, :] - lat[:, None]) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin(np.radians(lngs[None, :] - lng[:, None]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def tiles(places: DataFrame, k: int, tile: int = TILE) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """places(id, lat, lng) with their tile; the tiles' boxes (tiles x 6: least and greatest x, y, z) and sizes."""
    known = places.filter("lat between -90 and 90 and lng is not null and not isnan(lng) and id is not null").select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).distinct()
    known = known.withColumn("_n", F.row_number().over(W.partitionBy("lat", "lng").orderBy("id"))).filter(F.col("_n") <= k).drop("_n")
    known = known_table = materialise(known, "places")
    count = known.select("lat", "lng").distinct().count()
    number = min(MOST_TILES, max(1, -(-count // tile)))
    across = max(1, math.isqrt(number - 1) + 1)
    share = F.array(*(F.lit(i / across) for i in range(1, across))) if across > 1 else F.lit(None)
    spots = known.select("lat", "lng").distinct()
    cut = lambda df, c: df.agg(F.percentile_approx(c, share, 10_000).alias("q")) if across > 1 else None
    edges = [] if across == 1 else cut(spots, "lng").first().q or []
    slice_of = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("lng"))) if edges else F.lit(0)
    if across > 1:
        rows = cut(spots.groupBy(slice_of.alias("slice")), "lat")
        known = known.withColumn("slice", slice_of).join(F.broadcast(rows), "slice", "left")  # a row for each slice
        known = known.withColumn("tile", F.col("slice") * across + F.size(F.filter("q", lambda e: e < F.col("lat")))).select("id", "lat", "lng", "tile")
    else:
        known = known.withColumn("tile", F.lit(0))
    table, known = known_table, materialise(known.withColumn("tile", F.col("tile").cast("int")), "tiled-places")
    discard(table)
    a, b = F.radians("lat"), F.radians("lng")
    xyz = (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))
    got = known.groupBy("tile").agg(*(f(v).alias(f"{n}{i}") for i, v in enumerate(xyz) for n, f in (("low", F.min), ("high", F.max))), F.count("*").alias("n")).collect()  # MOST_TILES rows, about
    boxes = np.full((1 + max((r.tile for r in got), default=-1), 6), np.nan)
    size = np.zeros(len(boxes), dtype=np.int64)
    for r in got:
        boxes[r.tile] = [r.low0, r.low1, r.low2, r.high0, r.high1, r.high2]
        size[r.tile] = r.n
    return known, boxes, size


def box_distances(v: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest straight distance from each point to each box."""
    low, high = boxes[None, :, :3] - v[:, None, :], v[:, None, :] - boxes[None, :, 3:]
    near = np.sqrt((np.maximum(np.maximum(low, high), 0.0) ** 2).sum(axis=2))
    return near, np.sqrt((np.maximum(np.abs(low), np.abs(high)) ** 2).sum(axis=2))


def first_tiles(near: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """For each point (row) which boxes are the nearest ones that hold k places together."""
    order = np.argsort(near, axis=1, kind="stable")
    held = np.cumsum(size[order], axis=1)
    take = held - size[order] < k
    out = np.zeros(near.shape, dtype=bool)
    np.put_along_axis(out, order, take, axis=1)
    return out


def _chosen(points: DataFrame, boxes: np.ndarray, size: np.ndarray, k: int, bounded: bool) -> DataFrame:
    """points(id, lat, lng[, km]) with each tile to search: the first ones, or the others within the bound km."""
    some = np.flatnonzero(size)
    # boxes of boxes, so that a point meets a few hundred of them before it meets tiles
    step = max(1, math.isqrt(len(some)))
    groups = [some[i : i + step] for i in range(0, len(some), step)]
    outer = np.array([np.concatenate([boxes[g, :3].min(axis=0), boxes[g, 3:].max(axis=0)]) for g in groups])
    held = np.array([size[g].sum() for g in groups])
    shared = points.sparkSession.sparkContext.broadcast((boxes, size, groups, outer, held))

    def pick(v: np.ndarray, reach: np.ndarray | None):
        """(point, tile) pairs of a block of points."""
        boxes, size, groups, outer, held = shared.value
        near, far = box_distances(v, outer)
        # a bound from whole groups: the nearest by their far ends that hold k places
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.argmax(np.cumsum(held[order], axis=1) >= min(k, held.sum()), axis=1)
        limit = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
        inside = near <= limit[:, None] * (1 + SLACK) + SLACK
        if reach is not None:
            limit = np.minimum(limit, reach)
        for at in np.unique(inside, axis=0):
            who = np.flatnonzero((inside == at).all(axis=1))
            mine = np.concatenate([groups[g] for g in np.flatnonzero(at)])
            near_tile, _ = box_distances(v[who], boxes[mine])
            first = first_tiles(near_tile, size[mine], k)
            want = first if reach is None else ~first & (near_tile <= limit[who][:, None] * (1 + SLACK) + SLACK)
            i, j = np.nonzero(want)
            yield who[i], mine[j]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                lat, lng = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                reach = 2 * np.sin(np.minimum(part.column(3).to_numpy(zero_copy_only=False) / (2 * EARTH_KM), np.pi / 2)) if bounded else None
                for who, tile in pick(vectors(lat, lng), reach):
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in range(3)), pa.array(tile.astype(np.int32))], names=["id", "lat", "lng", "tile"])

    return points.mapInArrow(run, "id long, lat double, lng double, tile int")


def _searched(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The k nearest places of each asked(id, lat, lng, tile) in that tile: one task streams a tile's points past its places."""
    parts = asked.groupBy("tile").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))  # a row for each tile
    salt = F.pmod(F.xxhash64("id", "lat", "lng"), F.col("parts")).cast("int")
    q = asked.join(F.broadcast(parts), "tile").select("tile", salt.alias("part"), F.lit(1).alias("kind"), "id", "lat", "lng")
    p = placed.join(F.broadcast(parts), "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "lat", "lng")

    def nearest(held, id, lat, lng):
        own, la, ln = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        step = max(1, PAIRS // max(1, len(own)))
        for a in range(0, len(id) if len(own) else 0, step):
            b = slice(a, a + step)
            km = kilometres(lat[b], lng[b], la, ln)
            order = np.lexsort((np.broadcast_to(own, km.shape), km), axis=1)[:, :k]
            n = order.shape[1]
            cols = [np.repeat(x[b], n) for x in (id, lat, lng)] + [own[order].ravel(), np.take_along_axis(km, order, axis=1).ravel()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=[c.split()[0] for c in FOUND.split(", ")])

    def run(batches):
        held, at = [], None
        for batch in batches:
            tile, part, kind, id, lat, lng = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = np.flatnonzero((np.diff(tile) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(tile)]):
                if b > a:
                    if at != (tile[a], part[a]):
                        at, held = (tile[a], part[a]), []
                    if kind[a]:
                        yield from nearest(held, id[a:b], lat[a:b], lng[a:b])
                    else:
                        held.append((id[a:b], lat[a:b], lng[a:b]))

    return p.unionByName(q).repartition("tile", "part").sortWithinPartitions("tile", "part", "kind", "id").mapInArrow(run, FOUND)


def k_nearest(points: DataFrame, places: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """(id, lat, lng, other, rank, km): the k nearest places(id, lat, lng) of each of points(id, lat, lng), all of them if there are fewer.

    Ids are whole numbers.  Equal distances go by the place's id.  Points that repeat id and coordinates are one; points and places without a known
    coordinate or with a latitude beyond the poles, and places without an id, are left out."""
    ship(points.sparkSession)
    placed, boxes, size = tiles(places, k, tile)
    asked = points.filter("lat between -90 and 90 and lng is not null and not isnan(lng)").select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).distinct()
    if not size.sum():
        return asked.limit(0).select("*", F.lit(None).cast("long").alias("other"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("km"))
    first = materialise(_searched(_chosen(asked, boxes, size, k, False), placed, k), "first-tiles")
    bound = first.groupBy("id", "lat", "lng").agg(F.sort_array(F.collect_list("km")).alias("km")).select("id", "lat", "lng", F.get("km", F.lit(k - 1)).alias("km")).filter("km is not null")
    others = _searched(_chosen(bound, boxes, size, k, True), placed, k)
    order = W.partitionBy("id", "lat", "lng").orderBy("km", "other")
    out = first.unionByName(others).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = materialise(out.select("id", "lat", "lng", "other", "rank", "km"), "nearest")
    discard(placed, first)
    return out
