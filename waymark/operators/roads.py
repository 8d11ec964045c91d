"""Nearest road, coverage of streets by images, and road classes.

``edges`` has ``edge_id, highway, pts array<struct<lon, lat>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS_M, bearing, haversine
from waymark.operators.nearby import near_pairs
from waymark.sources.staging import stage


def segments(edges: DataFrame) -> DataFrame:
    """One row per straight piece: ``segment_id, edge_id, highway``, both ends and ``length_m``."""
    ends = F.arrays_zip(F.slice("pts", F.lit(1), F.greatest(F.size("pts") - 1, F.lit(0))).alias("a"), F.slice("pts", F.lit(2), F.greatest(F.size("pts") - 1, F.lit(0))).alias("b"))
    rows = edges.where("size(pts) >= 2").select("edge_id", "highway", F.posexplode(ends).alias("at", "s"))
    rows = rows.select(F.concat_ws(":", F.col("edge_id").cast("string"), F.col("at").cast("string")).alias("segment_id"), "edge_id", "highway", F.col("s.a.lon").alias("lon1"), F.col("s.a.lat").alias("lat1"), F.col("s.b.lon").alias("lon2"), F.col("s.b.lat").alias("lat2"))
    return rows.withColumn("length_m", haversine("lat1", "lon1", "lat2", "lon2"))


def samples(pieces: DataFrame, step_m: float) -> DataFrame:
    """Points along every segment, at most ``step_m`` apart, both ends included."""
    n = F.greatest(F.ceil(F.col("length_m") / step_m), F.lit(1))
    rows = pieces.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    share = F.col("i") / F.col("n")
    return rows.withColumns({"lat": F.col("lat1") + (F.col("lat2") - F.col("lat1")) * share, "lon": F.col("lon1") + (F.col("lon2") - F.col("lon1")) * share})


def segment_distance(lat: str, lon: str) -> Column:
    """Metres from a point to the segment of its row, in a plane around the point."""
    c = F.cos(F.radians(lat)) * EARTH_RADIUS_M
    x = lambda v: F.radians(F.pmod(F.col(v) - F.col(lon) + 180.0, F.lit(360.0)) - 180.0) * c
    y = lambda v: F.radians(F.col(v) - F.col(lat)) * EARTH_RADIUS_M
    dx, dy = x("lon2") - x("lon1"), y("lat2") - y("lat1")
    t = F.coalesce(F.try_divide(-(x("lon1") * dx + y("lat1") * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x("lon1") + t * dx, y("lat1") + t * dy)


def nearest_edge(points: DataFrame, edges: DataFrame, max_m: float = 50.0, step_m: float = 50.0) -> DataFrame:
    """For each point the nearest edge within ``max_m``: ``image_id, edge_id, highway, d_m``.

    Samples along the segments find the candidates by the near-point join, the exact
    distance to the candidate segments decides, ties go to the smaller edge id. Points
    with no edge that near have nulls.
    """
    pieces = segments(edges)
    marks = samples(pieces, step_m).select(F.col("segment_id").alias("image_id"), "lat", "lon")
    pairs = near_pairs(points, marks, max_m + step_m / 2).select(F.col("left_id").alias("image_id"), F.col("right_id").alias("segment_id")).distinct()
    met = pairs.join(points.select("image_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "image_id").join(pieces, "segment_id")
    # To the micrometre, so that edges which share a corner tie.
    met = met.withColumn("d_m", F.round(segment_distance("p_lat", "p_lon"), 6)).where(F.col("d_m") <= max_m)
    best = met.groupBy("image_id").agg(F.min(F.struct("d_m", "edge_id", "highway")).alias("b"))
    return points.select("image_id").join(best.select("image_id", "b.edge_id", "b.highway", "b.d_m"), "image_id", "left")


def street_coverage(edges: DataFrame, images: DataFrame, radius_m: float = 25.0, step_m: float = 20.0) -> DataFrame:
    """Per road class the length and the share of it with an image within ``radius_m``.

    Segments and samples are staged, so that the planner knows how many came out of few edges
    and doesn't broadcast them.
    """
    pieces = stage(segments(edges), "segments")
    marks = stage(samples(pieces, step_m).select(F.concat_ws("#", "segment_id", F.col("i").cast("string")).alias("image_id"), "segment_id", "lat", "lon"), "samples")
    seen = near_pairs(marks, images, radius_m).select(F.col("left_id").alias("image_id")).distinct().withColumn("seen", F.lit(1))
    per = marks.join(seen, "image_id", "left").groupBy("segment_id").agg((F.count("seen") / F.count("*")).alias("covered"))
    rows = pieces.join(per, "segment_id")
    return rows.groupBy("highway").agg(F.sum("length_m").alias("length_m"), F.try_divide(F.sum(F.col("length_m") * F.col("covered")), F.sum("length_m")).alias("covered_share"))


def road_class_table(first: DataFrame) -> DataFrame:
    """Per road class of the query: count, share, R@1, median wrong error, share of the errors above 1 km.

    ``first`` has one row per query: ``highway, error_m``.
    """
    total = first.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col("error_m") > 1000).alias("far"))).scalar()
    per = first.groupBy(F.coalesce("highway", F.lit("none")).alias("highway")).agg(
        F.count("*").alias("n"), F.avg((F.col("error_m") <= 25).cast("double")).alias("recall"),
        F.percentile(F.when(F.col("error_m") > 25, F.col("error_m")), F.lit(0.5)).alias("median_wrong_m"), F.count_if(F.col("error_m") > 1000).alias("n_far"),
    )
    return per.withColumn("total", total).select("highway", "n", (F.col("n") / F.col("total.n")).alias("share"), "recall", "median_wrong_m", F.try_divide("n_far", "total.far").alias("far_share"))


def faces(heading: str, dx: Column, dy: Column, within: float = 25.0, least_m: float = 15.0) -> Column:
    """Whether a camera looks at a point ``dx`` east and ``dy`` north of it, at least ``least_m`` away."""
    turn = F.abs(F.pmod(bearing(dx, dy) - F.col(heading) + 180.0, F.lit(360.0)) - 180.0)
    return F.coalesce((turn <= within) & (F.hypot(dx, dy) >= least_m), F.lit(False))
