"""The canonical frames of the engine: images, rankings, descriptors, districts.

``images`` has one row per image with cleaned values: unknown headings and times are
null, ``placed`` says whether the position is usable. ``rankings`` is the long form of
the stored result lists, best first from rank 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import normalize_heading, usable_position
from waymark.sources.tables import metadata, table

IMAGE_COLUMNS = ("sequence_id", "captured_at", "lat", "lon", "compass_angle", "is_pano", "creator_id", "split")


def images(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Newest state of every image; ``columns`` limits what is read."""
    wanted = columns or IMAGE_COLUMNS
    rows = metadata(spark, sf_dir, *wanted)
    if "captured_at" in wanted:
        rows = rows.withColumn("captured_at", F.nullif("captured_at", F.lit(0)))
    if "compass_angle" in wanted:
        rows = rows.withColumn("heading", normalize_heading("compass_angle"))
    if "lat" in wanted and "lon" in wanted:
        rows = rows.withColumn("placed", usable_position())
    return rows


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, rank, ref_id, sim`` of each query's newest list.

    Padding (-1), the query itself and repeats are dropped, unordered lists are put in
    order: by similarity, then by the smaller id.
    """
    stored = table(spark, sf_dir, "retrieval").groupBy("query_id").agg(F.max(F.struct("run_at", "indices", "similarities")).alias("s"))
    entries = stored.select("query_id", F.inline(F.arrays_zip(F.col("s.indices").alias("ref_id"), F.col("s.similarities").alias("sim"))))
    # A list is at most some tens wide, so this window sorts inside small groups.
    valid = entries.where((F.col("ref_id") >= 0) & (F.col("ref_id") != F.col("query_id"))).groupBy("query_id", "ref_id").agg(F.max(F.col("sim").cast("double")).alias("sim"))
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc_nulls_last(), "ref_id")
    return valid.select("query_id", F.row_number().over(order).cast("long").alias("rank"), "ref_id", "sim")


IMAGES_SQL = r"""m as (
  select image_id, trim(sequence_id, E' \t\n\r\x0b\x0c') as sequence_id, nullif(captured_at, 0) as captured_at, lat, lon, compass_angle,
         case when compass_angle >= 0 then compass_angle % 360 end as heading, is_pano, creator_id,
         nullif(lower(trim(split, E' \t\n\r\x0b\x0c')), '') as split,
         coalesce(lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0), false) as placed
  from (select *, row_number() over (partition by image_id order by ingested_at desc) as rn from metadata) where rn = 1)"""

RANKINGS_SQL = """l as (
  select query_id, indices, similarities from (select *, row_number() over (partition by query_id order by run_at desc) as rn from retrieval)
  where rn = 1 and indices is not null),
e as (select query_id, unnest(indices) as ref_id, unnest(similarities)::double as sim from l),
r as (select query_id, ref_id, sim, row_number() over (partition by query_id order by sim desc nulls last, ref_id) as rank
      from (select query_id, ref_id, max(sim) as sim from e where ref_id >= 0 and ref_id <> query_id group by 1, 2))"""


def metres_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * 6371000.0 * asin(least(1.0, sqrt({h})))"


def hits_sql(refs: str = "'database'") -> str:
    """CTEs ``q`` (queries), ``b`` (references) and ``h`` (result lists with distances)."""
    return f"""{IMAGES_SQL}, {RANKINGS_SQL},
q as (select * from m where split = 'query' and placed),
b as (select * from m where split in ({refs}) and placed),
h as (select r.query_id, r.ref_id, r.sim, row_number() over (partition by r.query_id order by r.rank) as rank,
        q.lat as q_lat, q.lon as q_lon, b.lat as r_lat, b.lon as r_lon, q.heading as q_heading, b.heading as r_heading,
        q.creator_id as q_creator, b.creator_id as r_creator, q.captured_at as q_at, b.captured_at as r_at,
        q.sequence_id as q_sequence, b.sequence_id as r_sequence, q.is_pano as q_pano, b.is_pano as r_pano, q.compass_angle as q_compass, b.compass_angle as r_compass,
        {metres_sql("q.lat", "q.lon", "b.lat", "b.lon")} as d_m
      from r join q on q.image_id = r.query_id join b on b.image_id = r.ref_id)"""
