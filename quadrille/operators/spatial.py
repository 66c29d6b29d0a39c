"""Coordinates: distance, cell indexing, registries, nearest and radius joins.

Cells come from an indexer: the square grid is pure column arithmetic; S2 cells are computed with column arithmetic
too.  Nearest and radius joins never compare all pairs: both sides meet in grid cells whose width covers
the radius, and distance is the residual."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EARTH_KM = 6371.0088
KM_PER_DEGREE = EARTH_KM * math.pi / 180
PILE = 512  # rows at one coordinate that are paired as one list
TASK_PAIRS = 1 << 22
MOST_TASKS = 20_000


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = (F.col(x) if isinstance(x, str) else x for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


class SquareGrid:
    """Cells of `step` degrees named row_column."""

    def __init__(self, step: float = 0.01):
        self.step = step

    def index(self, lat, lng) -> Column:
        return F.concat_ws("_", F.floor(lat / self.step).cast("string"), F.floor(lng / self.step).cast("string"))

    def ring(self, cell: Column, k: int = 1) -> Column:
        """The cell and its neighbours up to k rows or columns away."""
        parts = F.split(cell, "_")
        r, c = parts[0].cast("long"), parts[1].cast("long")
        steps = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1)]
        return F.array(*(F.concat_ws("_", (r + i).cast("string"), (c + j).cast("string")) for i, j in steps))

    def centroid(self, cell: Column) -> tuple[Column, Column]:
        parts = F.split(cell, "_")
        return (parts[0].cast("double") + 0.5) * self.step, (parts[1].cast("double") + 0.5) * self.step

    def area_km2(self, cell: Column) -> Column:
        lat = self.centroid(cell)[0]
        return F.pow(F.lit(self.step * KM_PER_DEGREE), 2) * F.cos(F.radians(lat))

    def boundary(self, cell: Column) -> Column:
        """The closed ring of corners as (lng, lat) pairs."""
        parts = F.split(cell, "_")
        s, w = parts[0].cast("double") * self.step, parts[1].cast("double") * self.step
        n, e = s + self.step, w + self.step
        return F.array(*(F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))))


class HexGrid:
    """Hexagonal cells of equal area named h{resolution}_{q}_{r}; all column arithmetic.

    Axial coordinates over the cylindrical equal-area projection with one standard parallel, near which cells are regular hexagons.
    A cell's area is the mean area of the usual hexagonal grid of that resolution (a seventh of the area per step); the names
    are this engine's own, not that grid's.  Cells end at the 180th meridian."""

    def __init__(self, resolution: int = 8, parallel: float = 40.7):
        self.resolution = resolution
        self.area = 4 * math.pi * EARTH_KM**2 / (2 + 120 * 7**resolution)
        self.size = math.sqrt(self.area * 2 / (3 * math.sqrt(3)))
        self.across, self.along = EARTH_KM * math.cos(math.radians(parallel)), EARTH_KM / math.cos(math.radians(parallel))

    def _name(self, q: Column, r: Column) -> Column:
        return F.concat_ws("_", F.lit(f"h{self.resolution}"), q.cast("long").cast("string"), r.cast("long").cast("string"))

    @staticmethod
    def _axes(cell: Column) -> tuple[Column, Column]:
        parts = F.split(cell, "_")
        return parts[1].cast("long"), parts[2].cast("long")

    def index(self, lat, lng) -> Column:
        x, y = F.radians(lng) * self.across, F.sin(F.radians(lat)) * self.along
        q, r = (x * (math.sqrt(3) / 3) - y / 3) / self.size, y * (2 / 3) / self.size
        a, b, c = F.rint(q), F.rint(r), F.rint(-q - r)  # the three coordinates add up to 0: mend the one that was rounded most
        da, db, dc = F.abs(a - q), F.abs(b - r), F.abs(c + q + r)
        return self._name(F.when((da > db) & (da > dc), -b - c).otherwise(a), F.when((db > dc) & ~((da > db) & (da > dc)), -a - c).otherwise(b))

    def ring(self, cell: Column, k: int = 1) -> Column:
        """The cell and its neighbours up to k steps away."""
        q, r = self._axes(cell)
        steps = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if abs(i + j) <= k]
        return F.array(*(self._name(q + i, r + j) for i, j in steps))

    def _point(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(F.asin(F.least(F.greatest(y / self.along, F.lit(-1.0)), F.lit(1.0)))), F.degrees(x / self.across)

    def centroid(self, cell: Column) -> tuple[Column, Column]:
        q, r = self._axes(cell)
        return self._point(self.size * math.sqrt(3) * (q + r / 2), self.size * 1.5 * r)

    def area_km2(self, cell: Column) -> Column:
        return F.lit(self.area)

    def boundary(self, cell: Column) -> Column:
        """The closed ring of six corners as (lng, lat) pairs."""
        q, r = self._axes(cell)
        x, y = self.size * math.sqrt(3) * (q + r / 2), self.size * 1.5 * r
        corners = [self._point(x + self.size * math.cos(math.radians(60 * i + 30)), y + self.size * math.sin(math.radians(60 * i + 30))) for i in (0, 1, 2, 3, 4, 5, 0)]
        return F.array(*(F.array(lng, lat) for lat, lng in corners))


class S2Grid:
    """Cells of the S2 sphere decomposition at one level, named by their curve tokens.

    The quadratic projection, face numbering and curve are the published ones.  Index and face/i/j names are column arithmetic;
    rings, centroids, areas and corners belong to distinct cells, which are few (`describe`)."""

    # Fixed values of the curve: the place of a quarter by orientation and (i, j) bits, and how each place turns the next level.
    PLACE = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
    TURN = (1, 0, 0, 3)

    def __init__(self, level: int = 13):
        self.level, self.side = level, 1 << level

    def _face_i_j(self, lat, lng) -> tuple[Column, Column, Column]:
        p, q = F.radians(lat), F.radians(lng)
        x, y, z = F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)
        ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
        axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
        main = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
        face = axis + F.when(main < 0, 3).otherwise(0)
        pick = lambda *c: F.when(face == 0, c[0]).when(face == 1, c[1]).when(face == 2, c[2]).when(face == 3, c[3]).when(face == 4, c[4]).otherwise(c[5])
        u = pick(y / x, -x / y, -x / z, z / x, z / y, -y / z)
        v = pick(z / x, z / y, -y / z, y / x, -x / y, -x / z)
        st = lambda t: F.when(t >= 0, F.sqrt(1 + 3 * t) * 0.5).otherwise(1 - F.sqrt(1 - 3 * t) * 0.5)
        cell = lambda t: F.least(F.greatest(F.floor(st(t) * self.side), F.lit(0)), F.lit(self.side - 1)).cast("long")
        return face, cell(u), cell(v)

    def face_name(self, lat, lng) -> Column:
        """face/i/j of the cell."""
        return F.concat_ws("/", *(c.cast("string") for c in self._face_i_j(lat, lng)))

    def index(self, lat, lng) -> Column:
        """The token of the cell."""
        face, i, j = self._face_i_j(lat, lng)
        spot = F.struct(face.cast("long").alias("face"), i.alias("i"), j.alias("j"))
        place, turn = F.array(*(F.lit(x) for row in self.PLACE for x in row)), F.array(*map(F.lit, self.TURN))

        def down(state, k):
            bit = lambda c: F.call_function("shiftright", state[c], k).bitwiseAND(F.lit(1))
            at = F.get(place, (state["turn"] * 4 + bit("i") * 2 + bit("j")).cast("int"))
            return F.struct(state["i"].alias("i"), state["j"].alias("j"), (state["pos"] * 4 + at).alias("pos"), state["turn"].bitwiseXOR(F.get(turn, at)).alias("turn"))

        zero = F.struct(spot["i"].alias("i"), spot["j"].alias("j"), F.lit(0).cast("long").alias("pos"), spot["face"].cast("int").bitwiseAND(F.lit(1)).alias("turn"))
        levels = F.array(*map(F.lit, range(self.level - 1, -1, -1))) if self.level else F.array().cast("array<int>")
        pos = F.aggregate(levels, zero, down)["pos"]
        cell = F.shiftleft(spot["face"], 61).bitwiseOR(F.shiftleft(pos * 2 + 1, 60 - 2 * self.level))
        return F.regexp_replace(F.lower(F.lpad(F.hex(cell), 16, "0")), "0+$", "")

    @classmethod
    def parse(cls, token: str) -> tuple[int, int, int, int]:
        """face, i, j and level of a token."""
        n = int(token.ljust(16, "0"), 16)
        low = (n & -n).bit_length() - 1
        if n <= 0 or low % 2 or n >> 61 > 5:
            raise ValueError(f"{token!r} is no cell")
        level, face = (60 - low) // 2, n >> 61
        i = j = 0
        turn = face & 1
        for k in range(level):
            at = n >> (59 - 2 * k) & 3
            ij = cls.PLACE[turn].index(at)
            i, j, turn = i * 2 + (ij >> 1), j * 2 + (ij & 1), turn ^ cls.TURN[at]
        return face, i, j, level

    @classmethod
    def token(cls, face: int, i: int, j: int, level: int) -> str:
        pos, turn = 0, face & 1
        for k in range(level - 1, -1, -1):
            at = cls.PLACE[turn][(i >> k & 1) * 2 + (j >> k & 1)]
            pos, turn = pos * 4 + at, turn ^ cls.TURN[at]
        return f"{face << 61 | (pos * 2 + 1) << 60 - 2 * level:016x}".rstrip("0")

    @staticmethod
    def _xyz(face: int, u: float, v: float) -> tuple[float, float, float]:
        return ((1.0, u, v), (-u, 1.0, v), (-u, -v, 1.0), (-1.0, -v, -u), (v, -1.0, -u), (v, u, -1.0))[face]

    @classmethod
    def _corner(cls, face: int, s: float, t: float) -> tuple[float, float, float]:
        uv = [(4 * x * x - 1) / 3 if x >= 0.5 else (1 - 4 * (1 - x) ** 2) / 3 for x in (s, t)]
        p = cls._xyz(face, *uv)
        n = math.sqrt(sum(c * c for c in p))
        return tuple(c / n for c in p)

    @staticmethod
    def _lat_lng(p) -> tuple[float, float]:
        return math.degrees(math.atan2(p[2], math.hypot(p[0], p[1]))), math.degrees(math.atan2(p[1], p[0]))

    @classmethod
    def beside(cls, token: str) -> list[str]:
        """The four cells across an edge."""
        face, i, j, level = cls.parse(token)
        side, out = 1 << level, []
        for a, b in ((i, j - 1), (i + 1, j), (i, j + 1), (i - 1, j)):
            if 0 <= a < side and 0 <= b < side:
                out.append(cls.token(face, a, b, level))
                continue
            edge = lambda x: max(-1 - 1e-12, min(1 + 1e-12, (2 * x + 1 - side) / side))  # noqa: E731  just over the face's edge
            p = cls._xyz(face, edge(a), edge(b))
            axis = max(range(3), key=lambda k: abs(p[k]))
            other = axis + (3 if p[axis] < 0 else 0)
            x, y, z = p
            u, v = ((y / x, z / x), (-x / y, z / y), (-x / z, -y / z), (z / x, y / x), (z / y, -x / y), (-y / z, -x / z))[other]
            at = [min(side - 1, max(0, int(math.floor((c + 1) / 2 * side)))) for c in (u, v)]
            out.append(cls.token(other, *at, level))
        return out

    @classmethod
    def ring(cls, token: str, k: int = 1) -> list[str]:
        """The cells at most k edges away, without the cell itself, sorted."""
        seen, edge = {token}, {token}
        for _ in range(k):
            edge = {n for c in edge for n in cls.beside(c)} - seen
            seen |= edge
        return sorted(seen - {token})

    @classmethod
    def corners(cls, token: str) -> list[tuple[float, float]]:
        face, i, j, level = cls.parse(token)
        side = 1 << level
        return [cls._lat_lng(cls._corner(face, a / side, b / side)) for a, b in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]

    @classmethod
    def centroid(cls, token: str) -> tuple[float, float]:
        face, i, j, level = cls.parse(token)
        side = 1 << level
        return cls._lat_lng(cls._corner(face, (i + 0.5) / side, (j + 0.5) / side))

    @classmethod
    def area_km2(cls, token: str) -> float:
        """The exact area: two spherical triangles."""
        face, i, j, level = cls.parse(token)
        side = 1 << level
        p = [cls._corner(face, a / side, b / side) for a, b in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))

        def triangle(a, b, c):
            ab, ac = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]
            cross = (ab[1] * ac[2] - ab[2] * ac[1], ab[2] * ac[0] - ab[0] * ac[2], ab[0] * ac[1] - ab[1] * ac[0])
            return 2 * math.atan2(dot(a, cross), 1 + dot(a, b) + dot(b, c) + dot(c, a))

        return abs(triangle(p[0], p[1], p[2]) + triangle(p[0], p[2], p[3])) * EARTH_KM**2

    @classmethod
    def describe(cls, cells: DataFrame, k: int = 1) -> DataFrame:
        """region_id with centroid_lat, centroid_lng, area_km2, neighbors (up to k edges) and corners (lat, lng) of cells(region_id)."""
        from quadrille.session import ship

        schema = "region_id string, centroid_lat double, centroid_lng double, area_km2 double, neighbors array<string>, corners array<array<double>>"

        def run(frames):
            import pandas as pd

            for pdf in frames:
                yield pd.DataFrame([(c, *cls.centroid(c), cls.area_km2(c), cls.ring(c, k), [list(x) for x in cls.corners(c)]) for c in pdf["region_id"]], columns=[c.split()[0] for c in schema.split(", ")])

        ship(cells.sparkSession)
        return cells.select("region_id").filter("region_id is not null").distinct().mapInPandas(run, schema)

    @staticmethod
    def average_area_km2(level: int) -> float:
        return 4 * math.pi * EARTH_KM**2 / (6 * 4**level)


def index_points(df: DataFrame, indexer, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Adds region_id.  Distinct coordinates are indexed once and joined back, as they are few beside the rows."""
    points = df.select(lat, lng).distinct().withColumn("region_id", indexer.index(F.col(lat), F.col(lng)))
    return df.join(points, [lat, lng], "left")


def station_registry(e: DataFrame) -> DataFrame:
    """One row per station of endpoints(station_id, name, ts, lat, lng, is_pickup)."""
    names = e.groupBy("station_id", "name").count()
    best = names.groupBy("station_id").agg(F.min_by("name", F.struct(-F.col("count"), "name")).alias("station_name"))
    q = lambda c, p: F.percentile(c, p)
    a = e.groupBy("station_id").agg(
        F.countDistinct("name").alias("n_distinct_names"), F.median("lat").alias("lat"), F.median("lng").alias("lng"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("appearances"), F.count_if("is_pickup").alias("pickups"), F.count_if(~F.col("is_pickup")).alias("dropoffs"), F.countDistinct(F.to_date("ts")).alias("active_days"),
        q("lat", 0.01).alias("lat_p01"), q("lat", 0.99).alias("lat_p99"), q("lng", 0.01).alias("lng_p01"), q("lng", 0.99).alias("lng_p99"))
    km = haversine_km("lat_p01", "lng_p01", "lat_p99", "lng_p99")
    return a.join(best, "station_id").withColumn("spread_km", km).withColumn("coord_anomaly", km > 0.5)


def _meet(a: DataFrame, b: DataFrame, radius_km: float) -> DataFrame:
    """Rows of a(a_lat, a_lng) and b(b_lat, b_lng) at most radius_km apart, with km.

    Both sides meet in latitude bands as high as the radius, cut into as many columns as keep each at least as wide as the radius
    at the band's and its neighbours' highest latitude; columns go round the globe, and a band at a pole is one."""
    step = radius_km / KM_PER_DEGREE

    def columns(band: Column) -> Column:
        top = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * step, F.lit(90.0))
        reach = 2 * F.asin(F.least(F.lit(math.sin(min(math.radians(step), math.pi) / 2)) / F.greatest(F.cos(F.radians(top)), F.lit(1e-9)), F.lit(1.0)))
        return F.greatest(F.floor(2 * math.pi / reach), F.lit(1)).cast("long")

    place = lambda lng, n: F.pmod(F.floor((F.col(lng) + 180) / 360 * n).cast("long"), n)
    band = lambda lat: F.floor(F.col(lat) / step).cast("long")
    left = a.withColumn("_r", band("a_lat")).withColumn("_c", place("a_lng", columns(F.col("_r"))))
    right = b.withColumn("_r", F.explode(F.array(*(band("b_lat") + i for i in (-1, 0, 1))))).withColumn("_n", columns(F.col("_r"))).withColumn("_c", place("b_lng", F.col("_n")))
    right = right.withColumn("_c", F.explode(F.array_distinct(F.array(*(F.pmod(F.col("_c") + i, F.col("_n")) for i in (-1, 0, 1)))))).drop("_n")
    km = haversine_km("a_lat", "a_lng", "b_lat", "b_lng")
    return left.join(right, ["_r", "_c"]).withColumn("km", km).filter(F.col("km") <= radius_km).drop("_r", "_c")


def _piles(p: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """The coordinates of p with the number of rows at each, and p's rows in lists of about `PILE` at one coordinate."""
    at = [f"{side}_lat", f"{side}_lng"]
    spots = p.groupBy(*at).agg(F.count("*").alias(f"_{side}n"))
    part = F.pmod(F.xxhash64(f"{side}_id"), F.ceil(F.col(f"_{side}n") / PILE)).alias(f"_{side}part")
    return spots, p.join(spots, at).groupBy(*at, part).agg(F.collect_list(F.struct(*(c for c in p.columns if c not in at))).alias(f"_{side}"))


def within(a: DataFrame, b: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of a(a_id, a_lat, a_lng) and b(b_id, b_lat, b_lng) at most radius_km apart, with km.

    Distances are those of distinct coordinates.  What is there is paired in lists, which are dealt by the number of pairs, so
    that a task makes about `TASK_PAIRS` of them whatever the crowds."""
    (here, own), (there, others) = _piles(a, "a"), _piles(b, "b")
    pairs = _meet(here, there, radius_km)
    total = pairs.agg(F.sum(F.col("_an").cast("double") * F.col("_bn"))).first()[0] or 0.0
    dealt = pairs.drop("_an", "_bn").join(own, ["a_lat", "a_lng"]).join(others, ["b_lat", "b_lng"])
    dealt = dealt.repartition(min(MOST_TASKS, int(total // TASK_PAIRS) + 1), "a_lat", "a_lng", "_apart", "b_lat", "b_lng", "_bpart")
    out = dealt.withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b"))
    held = lambda df, side: (F.col(c) if c in (f"{side}_lat", f"{side}_lng") else F.col(f"_{side}")[c].alias(c) for c in df.columns)
    return out.select(*held(a, "a"), *held(b, "b"), "km")


def _candidates(a: DataFrame, b: DataFrame, k: int, radius_km: float) -> DataFrame:
    """Each row of a with the k nearest rows of b within radius_km of its coordinate.

    Of rows of b at one coordinate only the k least ids can be among them, and a coordinate of a asks once for all that are there."""
    least = b.withColumn("_n", F.row_number().over(W.partitionBy("b_lat", "b_lng").orderBy("b_id"))).filter(F.col("_n") <= k).drop("_n")
    near = _meet(a.select("a_lat", "a_lng").distinct(), least, radius_km)
    near = near.withColumn("_n", F.row_number().over(W.partitionBy("a_lat", "a_lng").orderBy("km", "b_id"))).filter(F.col("_n") <= k).drop("_n")
    return a.join(near, ["a_lat", "a_lng"]).select(*a.columns, *b.columns, "km")


def nearest(a: DataFrame, b: DataFrame, k: int, radius_km: float) -> DataFrame:
    """The k nearest b within radius_km of each a, ranked; ties go to the lesser b_id."""
    w = W.partitionBy("a_id").orderBy("km", "b_id")
    return _candidates(a, b, k, radius_km).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def station_graph(points: DataFrame, k: int = 6, cap_km: float = 0.75) -> DataFrame:
    """Symmetric edges (u, v, km) of each point(id, lat, lng) to its k nearest within cap_km; ids are unique."""
    a = points.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    b = points.select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    w = W.partitionBy("a_id").orderBy("km", "b_id")
    e = _candidates(a, b, k + 1, cap_km).filter("a_id <> b_id").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)  # one of the k + 1 may be the point itself
    return e.select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), "km").union(e.select("b_id", "a_id", "km")).groupBy("u", "v").agg(F.min("km").alias("km"))


def padded_box(points: list[tuple[float, float]], pad_km: float) -> tuple[float, float, float, float]:
    """South, west, north, east of points with a margin; longitudes are widened by latitude."""
    lats, lngs = zip(*points)
    dy = pad_km / KM_PER_DEGREE
    dx = dy / max(0.01, math.cos(math.radians((min(lats) + max(lats)) / 2)))
    return min(lats) - dy, min(lngs) - dx, max(lats) + dy, max(lngs) + dx
