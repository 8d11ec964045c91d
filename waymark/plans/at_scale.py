"""Queries of problems 3 and 5: skewed keys and points near points or regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import hierarchy, skew
from waymark.plans.analyses import DISTRICT_SQL
from waymark.sources.staging import stage
from waymark.sources.tables import metadata, table
from waymark.sources.views import IMAGES_SQL, metres_sql

def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d, "sequence_id", "captured_at", "lat", "lon")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = stage(metadata(spark, d, "sequence_id"), "sequences")
    return skew.heavy_keys(rows, "sequence_id", 0.02).select("sequence_id")


def p3_frames(spark: SparkSession, d: str) -> DataFrame:
    return skew.frames(_tracks(spark, d)).withColumns({"step_m": F.round("step_m", 4), "speed_ms": F.round("speed_ms", 4)})


def p3_sequences(spark: SparkSession, d: str) -> DataFrame:
    return skew.sequence_stats(_tracks(spark, d)).withColumns({c: F.round(c, 3) for c in ("mean_gap_ms", "metres", "max_speed_ms")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    images = stage(metadata(spark, d, "lat", "lon", "split").where("split in ('query', 'database')"), "images")
    pairs = hierarchy.points_in_circles(images.where("split = 'query'"), images.where("split = 'database'"), 25.0)
    return pairs.select(F.least("left_id", "right_id").alias("image_id_a"), F.greatest("left_id", "right_id").alias("image_id_b"))


def p5_district(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.containing_region(metadata(spark, d, "lat", "lon"), table(spark, d, "districts"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_FRAMES_SQL = f"""with {IMAGES_SQL},
f as (select sequence_id, image_id, captured_at as t, lat, lon, placed from m where sequence_id is not null),
g as (select *, row_number() over w as frame_no, t - lag(t) over w as gap_ms,
        lag(lat) over w as lat0, lag(lon) over w as lon0, coalesce(lag(placed) over w, false) as placed0
      from f window w as (partition by sequence_id order by t nulls last, image_id)),
s as (select *, case when placed and placed0 then {metres_sql("lat0", "lon0", "lat", "lon")} end as step from g),
frames as (select sequence_id, image_id, frame_no, gap_ms, step as step_m, case when gap_ms > 0 then step / (gap_ms / 1000.0) end as speed_ms from s)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_district": f"with {IMAGES_SQL}, {DISTRICT_SQL} select m.image_id, district.district_id from m left join district using (image_id)",
        "p3_found": f"with {IMAGES_SQL} select sequence_id from m where sequence_id is not null group by 1 having count(*) * 50 >= (select count(*) from m)",
        "p3_frames": _FRAMES_SQL + "select sequence_id, image_id, frame_no, gap_ms, round(step_m, 4) as step_m, round(speed_ms, 4) as speed_ms from frames",
        "p3_sequences": _FRAMES_SQL
        + """select sequence_id, count(*) as n_frames, count(gap_ms) as n_gaps, round(avg(gap_ms), 3) as mean_gap_ms, max(gap_ms) as max_gap_ms,
          round(sum(step_m), 3) as metres, round(max(speed_ms), 3) as max_speed_ms from frames group by 1""",
        "p5_found": f"""with {IMAGES_SQL}, q as (select * from m where split = 'query' and placed), b as (select * from m where split = 'database' and placed)
          select least(q.image_id, b.image_id) as image_id_a, greatest(q.image_id, b.image_id) as image_id_b
          from q join b on b.lat between q.lat - 0.0003 and q.lat + 0.0003 where {metres_sql("q.lat", "q.lon", "b.lat", "b.lon")} <= 25""",
    }
