"""Twins: two images of one creator taken within a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import haversine, raw_turn


def copy_flag(max_degrees: float = 30.0) -> Column:
    """Same raw compass within ``max_degrees`` (-1 taken as 359 degrees) or both panoramas."""
    facing = raw_turn("q_compass", "r_compass") <= max_degrees
    return F.coalesce(facing, F.lit(False)) | F.coalesce(F.col("q_pano") & F.col("r_pano"), F.lit(False))


def twin_pairs(queries: DataFrame, references: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Pairs of the same known creator whose known times differ by at most ``window_ms``.

    An interval join as an equi-join on creator and time bucket, the query side standing in
    three buckets: a creator with a third of all rows is spread over as many keys as minutes.
    """
    columns = {"image_id": "id", "creator_id": "creator", "captured_at": "at", "lat": "lat", "lon": "lon", "compass_angle": "compass", "is_pano": "pano"}

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.where("creator_id is not null and captured_at is not null").select(*[F.col(c).alias(f"{mark}_{short}") for c, short in columns.items()])

    bucket = F.floor(F.col("q_at") / window_ms)
    q = side(queries, "q").withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    r = side(references, "r").withColumn("bucket", F.floor(F.col("r_at") / window_ms))
    met = q.join(r, (q["q_creator"] == r["r_creator"]) & (q["bucket"] == r["bucket"])).where((F.abs(F.col("q_at") - F.col("r_at")) <= window_ms) & (F.col("q_id") != F.col("r_id")))
    return met.select(
        F.col("q_id").alias("query_id"), F.col("r_id").alias("ref_id"), (F.col("r_at") - F.col("q_at")).alias("dt_ms"),
        haversine("q_lat", "q_lon", "r_lat", "r_lon").alias("d_m"), copy_flag().alias("is_copy"),
    )


def twin_counts(queries: DataFrame, references: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Per query: number of twins, whether one is a copy, smallest time difference. Queries without twins have 0."""
    per = twin_pairs(queries, references, window_ms).groupBy("query_id").agg(F.count("*").alias("n_twins"), F.bool_or("is_copy").alias("has_copy"), F.min(F.abs("dt_ms")).alias("min_dt_ms"))
    ids = queries.select(F.col("image_id").alias("query_id"))
    return ids.join(per, "query_id", "left").select("query_id", F.coalesce("n_twins", F.lit(0)).cast("long").alias("n_twins"), F.coalesce("has_copy", F.lit(False)).alias("has_copy"), "min_dt_ms")


def twin_shares(counts: DataFrame, found: DataFrame, is_twin: Column) -> DataFrame:
    """One row: queries, shares with a twin, with a copy, copies among twins, and of first hits that are twins."""
    first = found.where("rank = 1").select("query_id", is_twin.alias("first_is_twin"))
    has = F.col("n_twins") > 0
    return counts.join(first, "query_id", "left").agg(
        F.count("*").alias("n_queries"), F.avg(has.cast("double")).alias("twin_share"), F.avg(F.col("has_copy").cast("double")).alias("copy_share"),
        F.avg(F.when(has, F.col("has_copy").cast("double"))).alias("copy_share_of_twins"), F.avg(F.col("first_is_twin").cast("double")).alias("top1_twin_share"),
    )
