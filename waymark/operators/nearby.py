"""Radius joins as equi-joins on grid nodes.

A node is a cell as high as the circle; the columns of a row of nodes are halved towards
the poles, wrap at the 180th meridian, and join at the poles. Its name follows from the
position alone, so both sides find their nodes without anything to build or ship, and
columns of both sides can be carried through the join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS_M, haversine, usable_position


def _row(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height)


def _columns(row: Column, height: float) -> Column:
    """Columns of a row of nodes: a power of two whose cells are at least ``height`` metres wide."""
    widest = F.greatest(F.abs((row - 1) * height - 90.0), F.abs((row + 2) * height - 90.0))
    fit = F.floor(F.log2(360.0 / height * F.cos(F.radians(F.least(widest, F.lit(90.0))))))
    return F.when(widest >= 90.0, F.lit(0)).otherwise(F.greatest(fit, F.lit(0))).cast("int")


def _node(row: Column, column: Column, level: Column) -> Column:
    cells = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    return F.call_function("shiftleft", row.cast("long"), F.lit(32)) + F.pmod(column.cast("long"), cells)


def _column(lon: Column, level: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), level))


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, id_col: str = "image_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a ``left`` and a ``right`` point at most ``radius_m`` apart (inclusive).

    Both have ``<id_col>, lat, lon``. Returns ``left_id, right_id, d_m`` and the columns
    ``carry`` of both sides with the prefixes ``left_`` and ``right_``. Rows without a usable position are in no pair; rows at one place pair at distance 0; repeated ids
    give repeated pairs; other columns are ignored.
    """
    if not 0 < radius_m < 1_000_000:
        raise ValueError("radius_m must lie between 0 and 1,000 km")
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-12
    height = 2 * reach
    a = left.where(usable_position()).select(F.col(id_col).alias("left_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *[F.col(c).alias(f"left_{c}") for c in carry])
    b = right.where(usable_position()).select(F.col(id_col).alias("right_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), *[F.col(c).alias(f"right_{c}") for c in carry])
    row = _row(F.col("b_lat"), height)
    level = _columns(row, height)
    b = b.withColumn("node", _node(row, _column(F.col("b_lon"), level), level))

    polar = F.abs("a_lat") + reach >= 90.0
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(reach)) / F.cos(F.radians("a_lat"))))) * (1 + 1e-9) + 1e-12)
    a = a.withColumn("half", half)
    rows = F.sequence(F.greatest(_row(F.col("a_lat") - reach, height), F.lit(0)), F.least(_row(F.col("a_lat") + reach, height), F.floor(F.lit(180.0 / height))))
    a = a.withColumn("row", F.explode(rows)).withColumn("level", _columns(F.col("row"), height))
    cells = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    west = _column(F.col("a_lon") - F.col("half"), F.col("level"))
    east = F.least(_column(F.col("a_lon") + F.col("half"), F.col("level")), west + cells - 1)
    a = a.withColumn("column", F.explode(F.sequence(west, east)))
    a = a.select("left_id", "a_lat", "a_lon", "half", *[f"left_{c}" for c in carry], _node(F.col("row"), F.col("column"), F.col("level")).alias("node"))

    inside = (F.abs(F.pmod(F.col("b_lon") - F.col("a_lon") + 180.0, F.lit(360.0)) - 180.0) <= F.col("half")) & (F.abs(F.col("b_lat") - F.col("a_lat")) <= reach)
    met = a.join(b, "node").where(inside).withColumn("d_m", haversine("a_lat", "a_lon", "b_lat", "b_lon"))
    return met.where(F.col("d_m") <= radius_m).select("left_id", "right_id", "d_m", *[f"{side}_{c}" for c in carry for side in ("left", "right")])
