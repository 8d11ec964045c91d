"""Picking diverse examples and summaries for maps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import local_xy
from waymark.operators.nearby import near_pairs
from waymark.operators.roads import faces
from waymark.sources.staging import stage


def diverse_examples(candidates: DataFrame, n: int, fields: Sequence[str], order: str) -> list[dict]:
    """Up to ``n`` rows, each time the one that brings most new values of ``fields``.

    Greedy choice is sequential, so it takes ``n`` steps, each a distributed search over all
    candidates; the driver sees only the chosen rows. Ties go to the earlier row by ``order``.
    """
    rows = stage(candidates.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    chosen: list[dict] = []
    while len(chosen) < n:
        gain = F.lit(0)
        for f in fields:
            known = F.lit(False)
            for value in {r[f] for r in chosen}:
                known = known | F.col(f).eqNullSafe(F.lit(value))
            gain = gain + F.when(known, 0).otherwise(1)
        left = rows.where(~F.col("_row").isin([r["_row"] for r in chosen])) if chosen else rows
        best = left.orderBy(gain.desc(), order, "_row").first()
        if best is None:
            break
        chosen.append(best.asDict())
    return [{c: r[c] for c in candidates.columns} for r in chosen]


def scenes(cameras: DataFrame, targets: DataFrame, max_m: float = 80.0, within: float = 25.0, least_m: float = 15.0) -> DataFrame:
    """The nearest target each camera looks at: ``image_id, target_id, d_m``.

    ``cameras`` has ``image_id, lat, lon, heading``, ``targets`` has ``image_id, lat, lon``.
    """
    pairs = near_pairs(cameras, targets, max_m).withColumnsRenamed({"left_id": "camera_id", "right_id": "target_id"})
    rows = pairs.join(cameras.select(F.col("image_id").alias("camera_id"), "lat", "lon", "heading"), "camera_id").join(targets.select(F.col("image_id").alias("target_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), "target_id")
    dx, dy = local_xy("t_lat", "t_lon", "lat", "lon")
    best = F.min(F.struct("d_m", "target_id")).alias("b")
    return rows.where(faces("heading", dx, dy, within, least_m)).groupBy(F.col("camera_id").alias("image_id")).agg(best).select("image_id", F.col("b.target_id").alias("target_id"), F.col("b.d_m").alias("d_m"))


def blurred_density(images: DataFrame, width: int = 420, height: int = 300, sigma: float = 2.0) -> np.ndarray:
    """Log of one plus the Gaussian-blurred counts of placed images on a ``height x width`` grid.

    The counts, at most one row per cell, come from the cluster; the blur is separable.
    """
    placed = images.where("placed")
    box = placed.agg(F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1")).first()
    grid = np.zeros((height, width))
    if box["y0"] is None:
        return grid

    def cell(c: str, low: float, high: float, n: int):
        return F.least(F.floor((F.col(c) - low) / max(high - low, 1e-12) * n), F.lit(n - 1))

    for r in placed.groupBy(cell("lat", box["y0"], box["y1"], height).alias("i"), cell("lon", box["x0"], box["x1"], width).alias("j")).count().collect():
        grid[r["i"], r["j"]] = r["count"]
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(grid, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        grid = np.apply_along_axis(lambda v: np.convolve(v, kernel, mode="valid"), axis, padded)
    return np.log1p(grid)


def district_choice(districts: DataFrame, least_km2: float = 0.0) -> DataFrame:
    """Of districts that share a name the largest, smallest id on a tie; small ones are left out."""
    w = Window.partitionBy("district_name").orderBy(F.desc("area_km2"), "district_id")
    rows = districts.where(F.col("area_km2") >= least_km2)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("district_id", "district_name", "area_km2")
