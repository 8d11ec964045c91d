"""Queries on distances, joins and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import evaluation, nearby, twins
from waymark.plans.registry import Catalogue
from waymark.sources import views
from waymark.sources.staging import stage
from waymark.sources.views import IMAGES_SQL, hits_sql, metres_sql

catalogue = Catalogue()
query = catalogue.query
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql

THRESHOLDS, KS = evaluation.THRESHOLDS, evaluation.KS
FULL = ("database", "train")


class Scene:
    """Images, queries, references and result lists of one protocol, images staged once."""

    def __init__(self, spark: SparkSession, d: str, splits: tuple[str, ...] = ("database",), keep: Column | None = None):
        self.images = stage(views.images(spark, d), "images")
        self.queries = evaluation.queries_of(self.images, keep)
        self.references = evaluation.references_of(self.images, splits)
        self.hits = evaluation.hits(views.rankings(spark, d), self.queries, self.references)

    def near(self, radius_m: float) -> DataFrame:
        return evaluation.nearby(self.queries, self.references, radius_m)

    def recall(self, truth: Column | None = None) -> DataFrame:
        flags = evaluation.per_query(self.queries, self.near(max(THRESHOLDS)), self.hits, truth)
        return evaluation.recall(flags).withColumn("recall", F.round("recall", 6))


_FACING = "coalesce(least(abs(q_heading - r_heading), 360 - abs(q_heading - r_heading)) <= 90, true)"
_HARD = "coalesce(q_creator <> r_creator or abs(q_at - r_at) / 86400000.0 > 180, false)"
_TWIN = "coalesce(q_creator = r_creator and abs(q_at - r_at) <= 60000, false)"


def near_sql(radius: float) -> str:
    """CTE ``n``: all query-reference pairs within ``radius`` metres."""
    degrees = radius / 111_000
    return f"""n as (
  select q.image_id as query_id, b.image_id as ref_id, q.heading as q_heading, b.heading as r_heading, q.creator_id as q_creator, b.creator_id as r_creator,
    q.captured_at as q_at, b.captured_at as r_at, q.sequence_id as q_sequence, b.sequence_id as r_sequence, {metres_sql("q.lat", "q.lon", "b.lat", "b.lon")} as d_m
  from q join b on b.lat between q.lat - {degrees} and q.lat + {degrees} where {metres_sql("q.lat", "q.lon", "b.lat", "b.lon")} <= {radius})"""


def recall_sql(truth: str = "true", refs: str = "'database'", keep: str = "true") -> str:
    cells = ", ".join(f"({t}::double, {k})" for t in THRESHOLDS for k in KS)
    return f"""with {hits_sql(refs)}, {near_sql(100)},
qq as (select image_id as query_id from q where {keep}),
s as (select query_id, min(d_m) as nearest from n where {truth} group by 1),
c as (select * from (values {cells}) v(threshold_m, k)),
g as (select h.query_id, c.threshold_m, min(rank) as best from h cross join (select distinct threshold_m from c) c where d_m <= c.threshold_m and {truth} group by 1, 2),
f as (select c.threshold_m, c.k::int as k, count(*) as n_queries, count(*) filter (where s.nearest <= c.threshold_m) as n_solvable,
        count(*) filter (where s.nearest <= c.threshold_m and g.best <= c.k) as n_hits
      from qq cross join c left join s on s.query_id = qq.query_id left join g on g.query_id = qq.query_id and g.threshold_m = c.threshold_m group by 1, 2)
select *, round(case when n_solvable > 0 then n_hits / n_solvable end, 6) as recall from f"""


@query("a7_recall_all", recall_sql())
def a7_recall_all(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).recall()


@query("a7_recall_nopano", recall_sql(keep="not coalesce(is_pano, false)"))
def a7_recall_nopano(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d, keep=~F.coalesce("is_pano", F.lit(False))).recall()


@query("a7_recall_hard", recall_sql(_HARD))
def a7_recall_hard(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).recall(evaluation.hard_hit(180))


@query("a7_recall_heading", recall_sql(_FACING))
def a7_recall_heading(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).recall(evaluation.facing_hit(90))


@query("a7_recall_no_twins", recall_sql(f"not {_TWIN}"))
def a7_recall_no_twins(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).recall(evaluation.not_twin())


@query("k5_full_reference", recall_sql(refs="'database', 'train'"))
def k5_full_reference(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d, FULL).recall()


@query("t6_random_baseline")
def t6_random_baseline(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d)
    drawn = evaluation.random_rankings(s.queries, s.references, max(KS))
    s.hits = evaluation.hits(drawn, s.queries, s.references)
    return s.recall()


@query(
    "k6_density",
    f"""with {hits_sql("'database', 'train'")}, {near_sql(25)},
st as (select image_id as ref_id, case when split = 'database' then 0 when sequence_id is null then 4 else 1 + strpos('0123456789abcdef', substr(md5(sequence_id), 1, 1))::int // 4.0001 end as stage from b),
g as (select unnest([0, 1, 2, 3, 4]) as stage),
near as (select g.stage, n.query_id, count(*) as n from n join st using (ref_id) join g on st.stage <= g.stage group by 1, 2),
best as (select g.stage, h.query_id, arg_min(h.d_m, h.rank) as d from h join st using (ref_id) join g on st.stage <= g.stage group by 1, 2)
select g.stage::int as stage, count(*) as n_queries, count(near.n) as n_solvable, coalesce(sum(near.n), 0)::bigint as n_neighbours,
  count(*) filter (where best.d <= 25) as n_hits
from g cross join q left join near on near.stage = g.stage and near.query_id = q.image_id left join best on best.stage = g.stage and best.query_id = q.image_id
group by 1""".replace("1 + strpos('0123456789abcdef', substr(md5(sequence_id), 1, 1))::int // 4.0001", "1 + (strpos('0123456789abcdef', substr(md5(sequence_id), 1, 1)) - 1) // 4"),
)
def k6_density(spark: SparkSession, d: str) -> DataFrame:
    """Nested growth of the reference: database, then quarters of the train sequences; nothing is scored twice."""
    s = Scene(spark, d, FULL)
    quarter = F.floor((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("sequence_id"), 1, 1)) - 1) / 4) + 1
    level = F.when(F.col("split") == "database", F.lit(0)).when(F.col("sequence_id").isNull(), F.lit(4)).otherwise(quarter)
    levels = s.references.select(F.col("image_id").alias("ref_id"), level.cast("int").alias("level"))
    near = s.near(25.0).select("query_id", "ref_id").join(levels, "ref_id").groupBy("query_id").agg(*[F.count_if(F.col("level") <= g).alias(f"n{g}") for g in range(5)])
    best = s.hits.join(levels, "ref_id").groupBy("query_id").agg(*[F.min_by("d_m", F.when(F.col("level") <= g, F.col("rank"))).alias(f"d{g}") for g in range(5)])
    # min_by over ranks that are all null would take any row, so the count guards it.
    seen = s.hits.join(levels, "ref_id").groupBy("query_id").agg(F.min("level").alias("lowest"))
    rows = s.queries.select(F.col("image_id").alias("query_id")).join(near, "query_id", "left").join(best, "query_id", "left").join(seen, "query_id", "left")
    cells = [
        F.struct(
            F.lit(g).alias("stage"), F.count("*").alias("n_queries"), F.count_if(F.col(f"n{g}") > 0).alias("n_solvable"),
            F.coalesce(F.sum(f"n{g}"), F.lit(0)).alias("n_neighbours"), F.count_if((F.col("lowest") <= g) & (F.col(f"d{g}") <= 25)).alias("n_hits"),
        )
        for g in range(5)
    ]
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@query("g1_haversine_pairs", f"with {hits_sql()} select query_id, ref_id, rank, round(d_m, 4) as d_m from h")
def g1_haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).hits.select("query_id", "ref_id", "rank", F.round("d_m", 4).alias("d_m"))


@query(
    "g4_heading_matches",
    f"""with {hits_sql()} select query_id, ref_id, round(least(abs(q_heading - r_heading), 360 - abs(q_heading - r_heading)), 6) as turn, {_FACING} as matches,
  round(abs((q_compass - r_compass + 180) - 360 * floor((q_compass - r_compass + 180) / 360) - 180), 6) as raw_turn from h""",
)
def g4_heading_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = Scene(spark, d).hits
    return rows.select(
        "query_id", "ref_id", F.round(geo.heading_difference("q_heading", "r_heading"), 6).alias("turn"),
        geo.heading_matches("q_heading", "r_heading", 90).alias("matches"), F.round(geo.raw_turn("q_compass", "r_compass"), 6).alias("raw_turn"),
    )


@query("j1_solvable", f"with {hits_sql()}, {near_sql(100)} select query_id, round(min(d_m), 4) as nearest_m, count(*) as n_near from n group by 1")
def j1_solvable(spark: SparkSession, d: str) -> DataFrame:
    near = Scene(spark, d).near(100.0)
    return near.groupBy("query_id").agg(F.round(F.min("d_m"), 4).alias("nearest_m"), F.count("*").alias("n_near"))


@query("j2_query_db_pairs", f"with {hits_sql()}, {near_sql(50)} select query_id, ref_id, round(d_m, 3) as d_m from n")
def j2_query_db_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).near(50.0).select("query_id", "ref_id", F.round("d_m", 3).alias("d_m"))


@query(
    "j3_train_pairs",
    f"""with {IMAGES_SQL}, t as (select * from m where split = 'train' and placed and sequence_id is not null)
select a.image_id as image_id_a, b.image_id as image_id_b, round({metres_sql("a.lat", "a.lon", "b.lat", "b.lon")}, 3) as d_m
from t a join t b on b.lat between a.lat - 0.0001 and a.lat + 0.0001 and a.image_id < b.image_id and a.sequence_id <> b.sequence_id
where {metres_sql("a.lat", "a.lon", "b.lat", "b.lon")} <= 10 and coalesce(least(abs(a.heading - b.heading), 360 - abs(a.heading - b.heading)) <= 90, true)""",
)
def j3_train_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Positive pairs of train: within 10 m, of two sequences, facing the same way; each pair once."""
    train = stage(views.images(spark, d, "sequence_id", "lat", "lon", "compass_angle", "split").where("split = 'train' and placed and sequence_id is not null"), "train")
    pairs = nearby.near_pairs(train, train, 10.0, carry=("sequence_id", "heading"))
    ok = (F.col("left_id") < F.col("right_id")) & (F.col("left_sequence_id") != F.col("right_sequence_id")) & geo.heading_matches("left_heading", "right_heading", 90)
    return pairs.where(ok).select(F.col("left_id").alias("image_id_a"), F.col("right_id").alias("image_id_b"), F.round("d_m", 3).alias("d_m"))


_TWINS_SQL = f"""with {hits_sql("'database', 'train'")},
tw as (select q.image_id as query_id, abs(b.captured_at - q.captured_at) as dt,
    coalesce(abs((q.compass_angle - b.compass_angle + 180) - 360 * floor((q.compass_angle - b.compass_angle + 180) / 360) - 180) <= 30, false) or coalesce(q.is_pano and b.is_pano, false) as is_copy
  from q join b on q.creator_id = b.creator_id and b.captured_at between q.captured_at - 60000 and q.captured_at + 60000),
t as (select q.image_id as query_id, count(tw.query_id) as n_twins, coalesce(bool_or(is_copy), false) as has_copy, min(dt) as min_dt_ms from q left join tw on tw.query_id = q.image_id group by 1)
"""


@query("j7_twins", _TWINS_SQL + "select * from t")
def j7_twins(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d, FULL)
    return twins.twin_counts(s.queries, s.references)


@query(
    "a12_twin_shares",
    _TWINS_SQL
    + f"""select count(*) as n_queries, round(avg((n_twins > 0)::int), 6) as twin_share, round(avg(has_copy::int), 6) as copy_share,
  round(avg(has_copy::int) filter (where n_twins > 0), 6) as copy_share_of_twins, round(avg(first::int), 6) as top1_twin_share
from t left join (select query_id, {_TWIN} as first from h where rank = 1) f using (query_id)""",
)
def a12_twin_shares(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d, FULL)
    rows = twins.twin_shares(twins.twin_counts(s.queries, s.references), s.hits, evaluation.twin())
    return rows.select("n_queries", *[F.round(c, 6).alias(c) for c in rows.columns if c != "n_queries"])


@query(
    "s17_deg2tile",
    f"""with {IMAGES_SQL} select image_id, floor((lon + 180.0) / 360.0 * 16384)::bigint as tile_x,
  floor((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 16384)::bigint as tile_y from m where placed and abs(lat) < 85""",
)
def s17_deg2tile(spark: SparkSession, d: str) -> DataFrame:
    rows = views.images(spark, d, "lat", "lon").where("placed and abs(lat) < 85")
    return rows.select("image_id", geo.tile_x("lon", 14).alias("tile_x"), geo.tile_y("lat", 14).alias("tile_y"))


@query(
    "s18_px2deg",
    f"""with {IMAGES_SQL}, t as (select image_id, floor((lon + 180.0) / 360.0 * 16384)::bigint as x, floor((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 16384)::bigint as y,
    image_id % 4096 as px, image_id % 4093 as py from m where placed and abs(lat) < 85)
select image_id, round((x + px / 4096.0) / 16384.0 * 360.0 - 180.0, 9) as lon, round(degrees(atan(sinh(pi() * (1 - 2 * ((y + (1.0 - py / 4096.0)) / 16384.0))))), 9) as lat from t""",
)
def s18_px2deg(spark: SparkSession, d: str) -> DataFrame:
    rows = s17_deg2tile(spark, d)
    lon = geo.tile_pixel_to_lon(F.col("tile_x"), F.col("image_id") % 4096, 14)
    lat = geo.tile_pixel_to_lat(F.col("tile_y"), F.col("image_id") % 4093, 14)
    return rows.select("image_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(
    "s16_tiles_for_bounds",
    """with p as (select district_id, unnest(flatten(rings)) as p from districts),
b as (select district_id, min(p.lon) as x0, max(p.lon) as x1, min(p.lat) as y0, max(p.lat) as y1 from p group by 1),
t as (select district_id, floor((x0 + 180.0) / 360.0 * 1024)::bigint as i0, floor((x1 + 180.0) / 360.0 * 1024)::bigint as i1,
  floor((1.0 - asinh(tan(radians(y1))) / pi()) / 2.0 * 1024)::bigint as j0, floor((1.0 - asinh(tan(radians(y0))) / pi()) / 2.0 * 1024)::bigint as j1 from b),
i as (select *, unnest(generate_series(i0, i1)) as tile_x from t)
select district_id, tile_x, unnest(generate_series(j0, j1)) as tile_y from i""",
)
def s16_tiles_for_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Tiles at zoom 10 that cover the bounding box of each district."""
    points = views.table(spark, d, "districts").select("district_id", F.inline(F.flatten("rings")))
    box = points.groupBy("district_id").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    xs = F.sequence(geo.tile_x("x0", 10), geo.tile_x("x1", 10))
    ys = F.sequence(geo.tile_y("y1", 10), geo.tile_y("y0", 10))
    return box.withColumn("tile_x", F.explode(xs)).withColumn("tile_y", F.explode(ys)).select("district_id", "tile_x", "tile_y")
