"""Points in triangles through bounding-volume hierarchies (problem 5).

Boxes are put in the order of a space-filling curve; eight neighbours in that order share
a node whose box is fitted to them, eight nodes share one above, up to the root. Points go
down from the root, all at once, into every node whose box holds them.

Few triangles are broadcast whole. Otherwise the lower levels are spread over the cluster:
the curve is cut at quantiles from a bounded sketch, each piece gets the box fitted to all of
its items, and the hierarchy over these boxes, which is bounded, sends every point to the
pieces that may hold it. Crowded pieces become a grid of item parts and point parts. Each
task then builds the lower levels over its items and tests triangles exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS_M, usable_position
from waymark.operators.polygons import clip_convex, ear_clip
from waymark.sources.staging import stage

#: Triangles up to this number are broadcast (56 bytes each); more are spread over the cluster.
BROADCAST_TRIANGLES = 100_000
#: Children of a node.
FANOUT = 8
#: Items of a piece of the curve, and most pieces.
PIECE_ITEMS, MAX_PIECES = 16_384, 4096
#: Items and points of one task's cell, and points tested at a time.
CELL_ITEMS, CELL_POINTS, POINT_CHUNK = 65_536, 262_144, 4096


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place of each position on the Z curve over the globe, 26 bits for each axis."""

    def spread(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | (v << np.uint64(shift))) & np.uint64(mask)
        return v

    whole = (1 << 26) - 1
    u, v = (np.clip((c + 540.0) / 1080.0 * whole, 0, whole) for c in (x, y))
    return (spread(u) | (spread(v) << np.uint64(1))).astype(np.int64)


class Hierarchy:
    """Bounding-volume hierarchy over boxes ``x0, y0, x1, y1`` (n x 4)."""

    def __init__(self, boxes: np.ndarray):
        self.order = np.argsort(curve(boxes[:, [0, 2]].mean(1), boxes[:, [1, 3]].mean(1)), kind="stable")
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > FANOUT:
            below = self.levels[-1]
            starts = np.arange(0, len(below), FANOUT)
            self.levels.append(np.concatenate([np.minimum.reduceat(below[:, :2], starts), np.maximum.reduceat(below[:, 2:], starts)], axis=1))

    def holding(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point and box of every box that holds a point, edges included."""
        top = self.levels[-1]
        point, node = np.divmod(np.arange(len(x) * len(top)), max(len(top), 1))
        for depth in range(len(self.levels) - 1, -1, -1):
            box = self.levels[depth]
            inside = (box[node, 0] <= x[point]) & (x[point] <= box[node, 2]) & (box[node, 1] <= y[point]) & (y[point] <= box[node, 3])
            point, node = point[inside], node[inside]
            if depth:
                point = np.repeat(point, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < len(self.levels[depth - 1])
                point, node = point[real], node[real]
        return point, self.order[node]


class Triangles:
    """Triangles (n x 3 x 2, counter-clockwise) under a hierarchy."""

    def __init__(self, corners: np.ndarray):
        self.corners = corners
        self.tree = Hierarchy(np.concatenate([corners.min(axis=1), corners.max(axis=1)], axis=1).reshape(-1, 4))

    def holding(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point and triangle of every triangle that holds a point, edges included.

        An edge is measured from the same end in both triangles that share it, so no point on it is lost.
        """
        point, which = self.tree.holding(x, y)
        inside = np.ones(len(point), dtype=bool)
        px, py = x[point], y[point]
        for i in range(3):
            a, b = self.corners[which, i], self.corners[which, (i + 1) % 3]
            swap = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
            p, q = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
            side = (q[:, 0] - p[:, 0]) * (py - p[:, 1]) - (q[:, 1] - p[:, 1]) * (px - p[:, 0])
            inside &= np.where(swap, side <= 0, side >= 0)
        return point[inside], which[inside]


Kernel = Callable[[pa.Table], Callable[[pa.Table], Iterator[pa.RecordBatch]]]


def values(table: pa.Table) -> np.ndarray:
    """The column ``v`` as a matrix."""
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def meet(items: DataFrame, points: DataFrame, kernel: Kernel, schema: str, piece_items: int = PIECE_ITEMS, cell_items: int = CELL_ITEMS, cell_points: int = CELL_POINTS) -> DataFrame:
    """Brings every point together with the items whose boxes may hold it.

    ``items`` has ``item, v array<double>, x0, y0, x1, y1``, ``points`` has ``point,
    v array<double>`` with the position x, y first. ``kernel`` gets a cell's items and
    returns what is called with chunks of its points. Both inputs are scanned a few times.
    """
    spark = items.sparkSession
    n = items.count()
    if not n:
        return spark.createDataFrame([], schema)

    @F.pandas_udf("long")
    def place(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(curve(x.to_numpy(), y.to_numpy()))

    placed = items.withColumn("at", place((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2))
    pieces = int(min(MAX_PIECES, max(1, round(n / piece_items))))
    fractions = [i / pieces for i in range(1, pieces)]
    cuts = np.unique(np.array(placed.agg(F.percentile_approx("at", fractions, 10 * pieces)).first()[0] if fractions else [], dtype=np.int64))

    @F.pandas_udf("int")
    def piece_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(), side="right").astype(np.int32))

    placed = placed.withColumn("piece", piece_of("at"))
    fitted = placed.groupBy("piece").agg(F.count("*").alias("n"), F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).toPandas()  # at most MAX_PIECES rows
    shared = spark.sparkContext.broadcast((Hierarchy(fitted.iloc[:, 2:].to_numpy(dtype=float)), fitted["piece"].to_numpy()))

    def sent(counting: bool):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, names = shared.value
            total = np.zeros(len(names), dtype=np.int64)
            for batch in batches:
                v = values(pa.Table.from_batches([batch]))
                if not len(v):
                    continue
                row, box = tree.holding(v[:, 0], v[:, 1])
                if counting:
                    total += np.bincount(box, minlength=len(names))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(names[box].astype(np.int32)), *[batch.column(i).take(pa.array(row)) for i in range(batch.num_columns)]], names=["piece", *batch.schema.names])
            if counting:
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(total)], names=["piece", "n"])

        return send

    kind = dict(points.dtypes)["point"]
    counts = {r["piece"]: r["n"] for r in points.mapInArrow(sent(True), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    sizes = [(int(p), max(1, -(-int(k) // cell_items)), max(1, -(-counts.get(int(p), 0) // cell_points))) for p, k in zip(fitted["piece"], fitted["n"])]
    parts = F.broadcast(spark.createDataFrame(sizes, "piece int, ip long, pp long"))

    def cell(i, j):
        return ((F.col("piece").cast("long") * F.lit(1 << 20) + i) * F.lit(1 << 20) + j).alias("cell")

    own = lambda of: F.pmod(F.xxhash64("v"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = placed.join(parts, "piece").select("piece", "item", "v", own("ip").alias("i"), each("pp").alias("j"))
    right = points.mapInArrow(sent(False), f"piece int, point {kind}, v array<double>").join(parts, "piece").select("piece", "point", "v", each("ip").alias("i"), own("pp").alias("j"))
    left = left.select(cell(F.col("i"), F.col("j")), F.lit(True).alias("is_item"), "item", F.lit(None).cast(kind).alias("point"), "v")
    right = right.select(cell(F.col("i"), F.col("j")), F.lit(False).alias("is_item"), F.lit(None).cast(dict(items.dtypes)["item"]).alias("item"), "point", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        some, rest = table.filter(table.column("is_item")), table.filter(pc.invert(table.column("is_item")))
        if some.num_rows and rest.num_rows:
            test = kernel(some)
            for at in range(0, rest.num_rows, POINT_CHUNK):
                yield from test(rest.slice(at, POINT_CHUNK))

    return left.unionByName(right).groupBy("cell").applyInArrow(work, schema)


def _circles(some: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Items are circles: ``v`` is lon, lat of the centre, half width and height of its quadrilateral, lon of the quadrilateral, radius."""
    v = values(some)
    lon, lat, half, reach, middle, radius = v.T
    ids = some.column("item").combine_chunks()
    west, east, south, north = middle - half, middle + half, lat - reach, lat + reach
    corners = np.stack([np.stack([west, south], 1), np.stack([east, south], 1), np.stack([east, north], 1), np.stack([west, north], 1)], 1)
    clipped = clip_convex(corners)
    triangles = Triangles(clipped.reshape(-1, 3, 2))
    each = clipped.shape[1]

    def test(points: pa.Table) -> Iterator[pa.RecordBatch]:
        p = values(points)
        point, which = triangles.holding(p[:, 0], p[:, 1])
        # A point on the diagonal is in both triangles of a circle.
        point, circle = np.divmod(np.unique(point * len(v) + which // each), len(v))
        phi, other = np.radians(lat[circle]), np.radians(p[point, 1])
        h = np.sin((other - phi) / 2) ** 2 + np.cos(phi) * np.cos(other) * np.sin(np.radians(p[point, 0] - lon[circle]) / 2) ** 2
        d = 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
        near = d <= radius[circle]
        names = points.column("point").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(circle[near])), names.take(pa.array(point[near])), pa.array(d[near])], names=["left_id", "right_id", "d_m"])

    return test


def points_in_circles(left: DataFrame, right: DataFrame, radius_m: float, id_col: str = "image_id", **sizes: int) -> DataFrame:
    """``left_id, right_id, d_m``: every ``right`` point at most ``radius_m`` from a ``left`` point (inclusive).

    The circle of each left point lies in a quadrilateral of meridians and parallels, which
    ear clipping cuts into triangles; points found in them are measured along the great
    circle. Quadrilaterals over the 180th meridian are there twice, those that hold a pole
    span all longitudes. Rows without a usable position are in no pair, rows at one place
    pair at distance 0, repeated ids give repeated pairs, other columns are ignored.
    """
    if not 0 < radius_m < 1_000_000:
        raise ValueError("radius_m must lie between 0 and 1,000 km")
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-12
    points = right.where(usable_position()).select(F.col(id_col).alias("point"), F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("v"))
    polar = F.abs("lat") + reach >= 90.0
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(reach)) / F.cos(F.radians("lat"))))) * (1 + 1e-9) + 1e-12)
    circles = left.where(usable_position()).select(F.col(id_col).alias("item"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).withColumn("half", half)
    beyond = F.when(polar, F.array(F.lit(0.0))).when(F.col("lon") + F.col("half") > 180.0, F.array("lon", F.col("lon") - 360.0)).when(F.col("lon") - F.col("half") < -180.0, F.array("lon", F.col("lon") + 360.0)).otherwise(F.array("lon"))
    circles = circles.withColumn("middle", F.explode(beyond))
    items = circles.select(
        "item", F.array("lon", "lat", "half", F.lit(reach), "middle", F.lit(float(radius_m))).alias("v"),
        (F.col("middle") - F.col("half")).alias("x0"), (F.col("lat") - reach).alias("y0"), (F.col("middle") + F.col("half")).alias("x1"), (F.col("lat") + reach).alias("y1"),
    )
    kinds = dict(items.dtypes)["item"], dict(points.dtypes)["point"]
    return meet(items, points, _circles, f"left_id {kinds[0]}, right_id {kinds[1]}, d_m double", **sizes)


def _triangulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["item", "rank", "v"]
    for batch in batches:
        rows = []
        for region, rank, rings in zip(*(c.to_pylist() for c in batch.columns)):
            rings = [None if r is None else [None if p is None else (p["lon"], p["lat"]) for p in r] for r in rings]
            rows += [(region, rank, [c for p in t for c in p]) for t in ear_clip(rings)]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.list_(pa.float64())))], names=names)


def triangles(regions: DataFrame, id_col: str = "district_id", rank_col: str = "area_km2") -> DataFrame:
    """``item, rank, v``: the triangles of all regions, ``v`` the corners x, y one after the other."""
    rows = regions.select(F.col(id_col).cast("long").alias("item"), F.col(rank_col).cast("double").alias("rank"), "rings").where("item is not null and rings is not null")
    return rows.mapInArrow(_triangulate, "item long, rank double, v array<double>")


class Regions:
    """Which region a point belongs to: the least rank, then the least id, of those that hold it."""

    def __init__(self, region: np.ndarray, rank: np.ndarray, corners: np.ndarray):
        known = np.where(np.isnan(rank), np.inf, rank)
        self.place = np.empty(len(region), dtype=np.int64)
        order = np.lexsort((region, known))
        self.place[order] = np.arange(len(region))
        self.names, self.ranks, self.triangles = region[order], known[order], Triangles(corners.reshape(-1, 3, 2))

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Place of each point's region in ``names`` and ``ranks``, or their length."""
        point, which = self.triangles.holding(x, y)
        best = np.full(len(x), len(self.names), dtype=np.int64)
        np.minimum.at(best, point, self.place[which])
        return best


def _regions(some: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    v = values(some)
    regions = Regions(some.column("item").to_numpy(), v[:, 6], v[:, :6])

    def test(points: pa.Table) -> Iterator[pa.RecordBatch]:
        p = values(points)
        best = regions.of(p[:, 0], p[:, 1])
        hit = np.flatnonzero(best < len(regions.names))
        yield pa.RecordBatch.from_arrays([points.column("point").combine_chunks().take(pa.array(hit)), pa.array(regions.ranks[best[hit]]), pa.array(regions.names[best[hit]])], names=["point", "rank", "item"])

    return test


def containing_region(points: DataFrame, regions: DataFrame, id_col: str = "image_id", region_col: str = "district_id", rank_col: str = "area_km2", broadcast: int = BROADCAST_TRIANGLES, **sizes: int) -> DataFrame:
    """For each point the region that covers it: ``<id_col>, <region_col>``.

    Boundaries count as covered, edges of holes too. Where regions overlap, the least
    ``rank_col`` wins (null last), then the least id, so a point on an edge that two
    triangles or two regions share comes out once. Points in no region or without a usable
    position have a null region. ``<id_col>`` is unique per row.
    """
    parts = stage(triangles(regions, region_col, rank_col), "triangles")
    n = parts.count()
    kind = dict(points.dtypes)[id_col]
    if n <= broadcast:
        rows = parts.orderBy("item", "v").toPandas()
        corners = np.stack(rows["v"].to_numpy()) if n else np.zeros((0, 6))
        shared = points.sparkSession.sparkContext.broadcast(Regions(rows["item"].to_numpy(dtype=np.int64), rows["rank"].to_numpy(dtype=float), corners))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                best = np.concatenate([np.zeros(0, np.int64), *[shared.value.of(x[i : i + POINT_CHUNK], y[i : i + POINT_CHUNK]) for i in range(0, len(x), POINT_CHUNK)]])
                hit = best < len(shared.value.names)
                names = np.append(shared.value.names, 0)[best]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, mask=~hit)], names=["id", "region"])

        here = points.select(F.col(id_col).alias("id"), *[F.when(usable_position(), F.col(c)).otherwise(F.lit(float("nan"))).cast("double").alias(c) for c in ("lon", "lat")])
        return here.mapInArrow(look_up, f"id {kind}, region long").select(F.col("id").alias(id_col), F.col("region").alias(region_col))

    corner = lambda i, f: f(F.element_at("v", 1 + i), F.element_at("v", 3 + i), F.element_at("v", 5 + i))
    ranked = F.concat("v", F.array(F.coalesce("rank", F.lit(float("nan")))))
    items = parts.select("item", ranked.alias("v"), corner(0, F.least).alias("x0"), corner(1, F.least).alias("y0"), corner(0, F.greatest).alias("x1"), corner(1, F.greatest).alias("y1"))
    here = points.where(usable_position()).select(F.col(id_col).alias("point"), F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("v"))
    met = meet(items, here, _regions, f"point {kind}, rank double, item long", **sizes)
    best = met.groupBy("point").agg(F.min(F.struct("rank", "item")).alias("best")).select(F.col("point").alias(id_col), F.col("best.item").alias(region_col))
    return points.select(id_col).join(best, id_col, "left")
