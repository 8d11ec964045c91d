"""Audit queries over metadata, split lists and result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import audit, evaluation, skew
from waymark.operators.quantiles import exact_quantiles
from waymark.plans.registry import Catalogue
from waymark.plans.retrieval import Scene, near_sql
from waymark.sources import views
from waymark.sources.staging import stage
from waymark.sources.tables import split_name, table, trimmed
from waymark.sources.views import IMAGES_SQL, hits_sql, metres_sql

catalogue = Catalogue()
query = catalogue.query
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql

M = f"with {IMAGES_SQL} "


@query("null_census", M + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} is null) as n_null, count(*) as n_rows from m" for c in ("image_id", *views.IMAGE_COLUMNS)))
def null_census(spark: SparkSession, d: str) -> DataFrame:
    return audit.null_census(views.images(spark, d).select("image_id", *views.IMAGE_COLUMNS))


@query("a1_split_counts", M + "select split, count(*) as n_images, count(distinct sequence_id) as n_sequences, count(distinct creator_id) as n_creators from m group by 1")
def a1_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_counts(views.images(spark, d, "sequence_id", "creator_id", "split"))


_SIZES = M + ", s as (select sequence_id, count(*) as n from m where sequence_id is not null group by 1) "


@query("a2_sequence_stats", _SIZES + "select count(*) as n_sequences, count(*) filter (where n = 1) as n_single, median(n) as median_n, round(avg(n), 6) as mean_n, min(n) as min_n, max(n) as max_n from s")
def a2_sequence_stats(spark: SparkSession, d: str) -> DataFrame:
    return audit.sequence_length_stats(views.images(spark, d, "sequence_id")).withColumn("mean_n", F.round("mean_n", 6))


@query(
    "a2_extreme_sequences",
    _SIZES + "(select *, 'longest' as \"end\" from s order by n desc, sequence_id limit 10) union all (select *, 'shortest' from s order by n, sequence_id limit 10)",
)
def a2_extreme_sequences(spark: SparkSession, d: str) -> DataFrame:
    return audit.extreme_sequences(views.images(spark, d, "sequence_id"))


@query(
    "a3_year_by_split",
    M + """select year(make_timestamp(captured_at * 1000)) as year, count(*) filter (where split = 'database') as database,
  count(*) filter (where split = 'query') as query, count(*) filter (where split = 'train') as train
from m where captured_at is not null and split in ('database', 'query', 'train') group by 1""",
)
def a3_year_by_split(spark: SparkSession, d: str) -> DataFrame:
    return audit.year_by_split(views.images(spark, d, "captured_at", "split"))


@query(
    "a4_split_consistency",
    M + "select sequence_id, count(*) as n_images, count(distinct split) as n_splits, case when count(distinct split) = 1 then min(split) end as split from m where sequence_id is not null group by 1",
)
def a4_split_consistency(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_consistency(views.images(spark, d, "sequence_id", "split"))


_NEIGHBOURS = f"""with {hits_sql("'database'")}, {near_sql(25)},
p as (select query_id, count(*) as n_near, coalesce(bool_or(q_creator = r_creator and abs(q_at - r_at) / 86400000.0 < 1), false) as same_creator_same_day,
  coalesce(bool_or(q_creator <> r_creator), false) as other_creator, min(abs(q_at - r_at) / 86400000.0) as min_days from n group by 1)
"""


@query("a5_neighbourhood", _NEIGHBOURS + "select query_id, n_near, same_creator_same_day, other_creator, round(min_days, 6) as min_days from p")
def a5_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return audit.neighbourhood(Scene(spark, d).near(25.0)).withColumn("min_days", F.round("min_days", 6))


@query(
    "a5_summary",
    _NEIGHBOURS + """select count(*) as n_queries, median(n_near) as median_near, round(avg(same_creator_same_day::int), 6) as same_day_share,
  round(avg(other_creator::int), 6) as other_creator_share, round(median(min_days), 6) as median_min_days from p""",
)
def a5_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.neighbourhood_summary(audit.neighbourhood(Scene(spark, d).near(25.0)))
    return rows.select("n_queries", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


@query(
    "a6_creator_share",
    M + """, c as (select creator_id, count(*) as n from m where creator_id is not null group by 1), t as (select sum(n) as total from c)
select creator_id, n, round(n / total, 6) as share, round(sum(n) over (order by n desc, creator_id rows unbounded preceding) / total, 6) as running_share
from c cross join t order by n desc, creator_id limit 3""",
)
def a6_creator_share(spark: SparkSession, d: str) -> DataFrame:
    return audit.creator_concentration(views.images(spark, d, "creator_id")).withColumns({"share": F.round("share", 6), "running_share": F.round("running_share", 6)})


@query(
    "a27_survey",
    M + """select split, count(*) as n_images, count(distinct sequence_id) as n_sequences, count(distinct creator_id) as n_creators,
  round(avg((year(make_timestamp(captured_at * 1000)) >= 2022)::int), 6) as recent_share, round(avg(is_pano::int), 6) as pano_share from m group by 1""",
)
def a27_survey(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.survey(views.images(spark, d, "sequence_id", "creator_id", "split", "captured_at", "is_pano"))
    return rows.withColumns({"recent_share": F.round("recent_share", 6), "pano_share": F.round("pano_share", 6)})


@query("a33_grid_density", M + "select floor(lat / 0.01)::bigint as cell_lat, floor(lon / 0.01)::bigint as cell_lon, count(*) as n from m where placed group by 1, 2")
def a33_grid_density(spark: SparkSession, d: str) -> DataFrame:
    return audit.grid_density(views.images(spark, d, "lat", "lon"), 0.01)


@query("densest_cell", M + "select floor(lat / 0.01)::bigint as cell_lat, floor(lon / 0.01)::bigint as cell_lon, count(*) as n from m where placed group by 1, 2 order by n desc, 1, 2 limit 1")
def densest_cell(spark: SparkSession, d: str) -> DataFrame:
    return audit.densest_cell(views.images(spark, d, "lat", "lon"), 0.01)


@query("year_hour", M + "select image_id, year(make_timestamp(captured_at * 1000)) as year, hour(make_timestamp(captured_at * 1000)) as hour from m where captured_at is not null")
def year_hour(spark: SparkSession, d: str) -> DataFrame:
    rows = views.images(spark, d, "captured_at").where("captured_at is not null").withColumn("ts", F.timestamp_millis("captured_at"))
    return rows.select("image_id", F.year("ts").cast("long").alias("year"), F.hour("ts").cast("long").alias("hour"))


_LISTS = r"s as (select distinct trim(sequence_id, E' \t\n\r\x0b\x0c') as sequence_id, nullif(lower(trim(split, E' \t\n\r\x0b\x0c')), '') as split from split_lists where sequence_id is not null)"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "split_lists").where("sequence_id is not null")
    return rows.select(trimmed("sequence_id").alias("sequence_id"), split_name("split").alias("split")).distinct()


@query(
    "j12_overlap",
    M + f""", {_LISTS}, k as (select distinct sequence_id from s)
select count(*) as n_keys, count(x.sequence_id) as n_common, round(count(x.sequence_id) / count(*), 6) as share
from k left join (select distinct sequence_id from m) x using (sequence_id)""",
)
def j12_overlap(spark: SparkSession, d: str) -> DataFrame:
    return audit.list_overlap(_lists(spark, d), views.images(spark, d, "sequence_id"), "sequence_id").withColumn("share", F.round("share", 6))


@query("j13_missing", M + ", k as (select distinct image_id from m) select image_id from k where image_id not in (select image_id from descriptors where image_id is not null)")
def j13_missing(spark: SparkSession, d: str) -> DataFrame:
    """Images without a descriptor."""
    return audit.missing_keys(table(spark, d, "metadata").select("image_id"), table(spark, d, "descriptors"), "image_id")


@query(
    "s20_missing_fraction",
    """with e as (select distinct image_id from metadata), p as (select distinct image_id from descriptors where image_id is not null)
select count(*) as expected, count(p.image_id) as present, count(*) - count(p.image_id) as missing, round((count(*) - count(p.image_id)) / count(*), 6) as fraction from e left join p using (image_id)""",
)
def s20_missing_fraction(spark: SparkSession, d: str) -> DataFrame:
    record = audit.missing_fraction(table(spark, d, "metadata").select("image_id"), table(spark, d, "descriptors").select("image_id"), "image_id")
    return spark.createDataFrame([tuple(record.values())], "expected long, present long, missing long, fraction double").withColumn("fraction", F.round("fraction", 6))


@query("set_intersect", f"with {_LISTS} select sequence_id from s where split = 'train' intersect select sequence_id from s where split <> 'train'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Sequences listed in train and in another split."""
    s = _lists(spark, d)
    return s.where("split = 'train'").select("sequence_id").intersect(s.where("split <> 'train'").select("sequence_id"))


@query("set_except", M + f", {_LISTS} select sequence_id from s except select sequence_id from m")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    """Listed sequences that no image has."""
    return _lists(spark, d).select("sequence_id").subtract(views.images(spark, d, "sequence_id").select("sequence_id"))


@query(
    "split_lookup",
    M + f", {_LISTS}, u as (select sequence_id, min(split) as listed, count(*) as n_listed from s group by 1) select image_id, split, listed, coalesce(split = listed, false) as agrees from m left join u using (sequence_id)",
)
def split_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The split of each image by the lists as once drawn (the least if listed twice)."""
    lists = _lists(spark, d).groupBy("sequence_id").agg(F.min("split").alias("listed"))
    rows = views.images(spark, d, "sequence_id", "split").join(lists, "sequence_id", "left")
    return rows.select("image_id", "split", "listed", F.coalesce(F.col("split") == F.col("listed"), F.lit(False)).alias("agrees"))


@query(
    "a1_district_names",
    f"""with {IMAGES_SQL}, d as (select district_id, district_name, area_km2 from districts),
i as (select district_name, count(*) as n_districts, round(sum(area_km2), 3) as area_km2 from d group by 1) select * from i""",
)
def a1_district_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "districts").groupBy("district_name").agg(F.count("*").alias("n_districts"), F.round(F.sum("area_km2"), 3).alias("area_km2"))


_STEPS = f"""{IMAGES_SQL},
g as (select *, captured_at - lag(captured_at) over w as dt, lag(lat) over w as lat0, lag(lon) over w as lon0, coalesce(lag(placed) over w, false) as placed0
  from m where sequence_id is not null and captured_at is not null window w as (partition by sequence_id order by captured_at, image_id)),
v as (select sequence_id, dt, {metres_sql("lat0", "lon0", "lat", "lon")} / (dt / 1000.0) as speed from g where placed and placed0 and dt > 0)
"""


@query("a34_sequence_speed", f"with {_STEPS} select sequence_id, count(*) as n_steps, round(median(speed) * 3.6, 4) as median_kmh from v where dt > 200 group by 1")
def a34_sequence_speed(spark: SparkSession, d: str) -> DataFrame:
    rows = _speeds(spark, d).where("gap_ms > 200")
    return rows.groupBy("sequence_id").agg(F.count("*").alias("n_steps"), F.round(F.percentile("speed_ms", F.lit(0.5)) * 3.6, 4).alias("median_kmh"))


@query("a35_median_speed", f"with {_STEPS} select count(*) as n_steps, round(median(speed), 4) as median_ms from v where dt <= 60000 and speed <= 50")
def a35_median_speed(spark: SparkSession, d: str) -> DataFrame:
    steps = stage(_speeds(spark, d).where("gap_ms <= 60000 and speed_ms <= 50").select("speed_ms"), "speeds")
    median = exact_quantiles(steps, "speed_ms", [0.5])[0]
    return steps.agg(F.count("*").alias("n_steps")).select("n_steps", F.round(F.lit(median).cast("double"), 4).alias("median_ms"))


def _speeds(spark: SparkSession, d: str) -> DataFrame:
    return skew.frames(views.images(spark, d, "sequence_id", "captured_at", "lat", "lon").where("captured_at is not null")).where("speed_ms is not null")


@query("w1_sequence_position", M + "select image_id, sequence_id, row_number() over (partition by sequence_id order by captured_at nulls last, image_id) as pos from m where sequence_id is not null")
def w1_sequence_position(spark: SparkSession, d: str) -> DataFrame:
    return skew.frames(views.images(spark, d, "sequence_id", "captured_at", "lat", "lon")).select("image_id", "sequence_id", F.col("frame_no").alias("pos"))


@query("a36_centroid", M + "select split, round(avg(lat), 9) as lat, round(avg(lon), 9) as lon from m where placed group by 1")
def a36_centroid(spark: SparkSession, d: str) -> DataFrame:
    return views.images(spark, d, "split", "lat", "lon").where("placed").groupBy("split").agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon"))


@query(
    "j6_pair_enrichment",
    f"with {hits_sql()}, {near_sql(25)} select query_id, ref_id, q_sequence, r_sequence, q_creator, r_creator, round(abs(q_at - r_at) / 86400000.0, 6) as days from n",
)
def j6_pair_enrichment(spark: SparkSession, d: str) -> DataFrame:
    near = Scene(spark, d).near(25.0)
    return near.select("query_id", "ref_id", "q_sequence", "r_sequence", "q_creator", "r_creator", F.round(evaluation.days_apart(), 6).alias("days"))
