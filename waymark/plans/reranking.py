"""Queries that re-rank result lists and estimate coordinates from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.geo import utm_xy, utm_zone
from waymark.operators import evaluation, localize, rerank, skew
from waymark.plans.analyses import rounded
from waymark.plans.registry import Catalogue
from waymark.plans.retrieval import _TWIN, FULL, Scene
from waymark.sources import views
from waymark.sources.staging import stage
from waymark.sources.views import IMAGES_SQL, RANKINGS_SQL, hits_sql, metres_sql

catalogue = Catalogue()
query = catalogue.query
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql
HF = hits_sql("'database', 'train'")


def _positions(spark: SparkSession, d: str, images: DataFrame | None = None) -> DataFrame:
    frames = skew.frames(views.images(spark, d, "sequence_id", "captured_at", "lat", "lon") if images is None else images)
    return frames.select("image_id", "sequence_id", F.col("frame_no").alias("pos"))


@query(
    "r1_sequence_aggregation",
    f"""with {IMAGES_SQL}, {RANKINGS_SQL},
p as (select image_id, sequence_id, row_number() over (partition by sequence_id order by captured_at nulls last, image_id) as pos from m where sequence_id is not null),
own as (select distinct r.query_id, p.sequence_id, p.pos from r join p on p.image_id = r.query_id),
x as (select own.query_id, r.ref_id, sum(r.sim * (1 - abs(p.pos - own.pos) / 4.0)) as sim from own join p on p.sequence_id = own.sequence_id and p.pos between own.pos - 3 and own.pos + 3
      join r on r.query_id = p.image_id group by 1, 2
      union all select query_id, ref_id, sim from r where query_id not in (select query_id from own)),
k as (select query_id, ref_id, round(sim, 6) as sim, row_number() over (partition by query_id order by round(sim, 9) desc nulls last, ref_id) as rank from x)
select * from k where rank <= 10""",
)
def r1_sequence_aggregation(spark: SparkSession, d: str) -> DataFrame:
    return rerank.sequence_window(stage(views.rankings(spark, d), "rankings"), _positions(spark, d), 3).withColumn("sim", F.round("sim", 6))


@query("r2_hmm")
def r2_hmm(spark: SparkSession, d: str) -> DataFrame:
    """The drives' speed is the median over the database frames."""
    s = Scene(spark, d, FULL)
    speed = rerank.drive_speed(evaluation.references_of(s.images))
    return rerank.hmm_smoothing(s.hits, _positions(spark, d, s.images), speed=speed)


@query("r3_twin_rerank", f"with {HF} select query_id, ref_id, row_number() over (partition by query_id order by {_TWIN}, rank) as rank, {_TWIN} as is_twin from h")
def r3_twin_rerank(spark: SparkSession, d: str) -> DataFrame:
    return rerank.twins_last(Scene(spark, d, FULL).hits, evaluation.twin()).select("query_id", "ref_id", "rank", "is_twin")


@query(
    "r4_inlier_rerank",
    f"""with {HF}, i as (select query_id, ref_id, rank as old, (query_id * 31 + ref_id * 17) % 60 as n from h)
select query_id, ref_id, row_number() over (partition by query_id order by case when old <= 5 then case when n >= 15 then 0 else 1 end else 2 end, case when old <= 5 and n >= 15 then -n end, old) as rank from i""",
)
def r4_inlier_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Inlier counts are derived from the ids, for there is no table of them."""
    inliers = (F.col("query_id") * 31 + F.col("ref_id") * 17) % 60
    return rerank.verified_first(Scene(spark, d, FULL).hits, inliers, 5, 15).select("query_id", "ref_id", "rank")


#: The weights of the detection score that are compared.
_WEIGHTS = (0.0, 0.05, 0.1, 0.2, 0.5, 1.0)


@query(
    "r7_fusion",
    f"""with {HF}, x as (select query_id, ref_id, rank, d_m, sim, case when ref_id % 7 <> 0 then ((query_id * 13 + ref_id * 29) % 100) / 100.0 end::double as det from h),
z as (select *, coalesce(case when sim is not null then case when stddev_pop(sim) over w > 0 then (sim - avg(sim) over w) / stddev_pop(sim) over w else 0 end end, 0) as zs,
  coalesce(case when det is not null then case when stddev_pop(det) over w > 0 then (det - avg(det) over w) / stddev_pop(det) over w else 0 end end, 0) as zd from x window w as (partition by query_id)),
lam as (select unnest([{", ".join(f"{w}::double" for w in _WEIGHTS)}]) as weight),
best as (select weight, query_id, d_m, row_number() over (partition by weight, query_id order by round(zs + weight * zd, 9) desc, rank) as nth from z cross join lam)
select weight, count(*) as n, count(*) filter (where d_m <= 25) as n_hits from best where nth = 1 group by 1""",
)
def r7_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Detection scores are derived from the ids; every seventh reference has none."""
    det = F.when(F.col("ref_id") % 7 != 0, ((F.col("query_id") * 13 + F.col("ref_id") * 29) % 100) / 100.0)
    best = rerank.fused_first(Scene(spark, d, FULL).hits.withColumn("det", det), _WEIGHTS)
    return best.groupBy("weight").agg(F.count("*").alias("n"), F.count_if(F.col("d_m") <= 25).alias("n_hits"))


@query("r8_mixed_queries", f"with {HF} select query_id from h where rank <= 10 group by 1 having bool_or(d_m <= 25) and bool_or(d_m > 25)")
def r8_mixed_queries(spark: SparkSession, d: str) -> DataFrame:
    return rerank.mixed_queries(Scene(spark, d, FULL).hits, F.col("d_m") <= 25, 10)


@query(
    "w2_frame_window",
    f"""with {IMAGES_SQL}, p as (select image_id, sequence_id, row_number() over (partition by sequence_id order by captured_at nulls last, image_id) as pos from m where sequence_id is not null)
select a.image_id, count(*) as n_frames from p a join p b on a.sequence_id = b.sequence_id and b.pos between a.pos - 3 and a.pos + 3 group by 1""",
)
def w2_frame_window(spark: SparkSession, d: str) -> DataFrame:
    """Frames within three positions, from the length of the sequence rather than a window over its rows."""
    rows = _positions(spark, d)
    sizes = rows.groupBy("sequence_id").agg(F.count("*").alias("n"))
    return rows.join(sizes, "sequence_id").select("image_id", (1 + F.least(F.col("pos") - 1, F.lit(3)) + F.least(F.col("n") - F.col("pos"), F.lit(3))).alias("n_frames"))


@query("l1_top1_error", f"with {HF} select query_id, r_lat as lat, r_lon as lon, round(d_m, 3) as error_m from h where rank = 1")
def l1_top1_error(spark: SparkSession, d: str) -> DataFrame:
    return localize.top1(Scene(spark, d, FULL).hits).withColumn("error_m", F.round("error_m", 3))


def _centroid_sql(weight: str) -> str:
    return f"""with {HF}, f as (select query_id, r_lat as lat1, r_lon as lon1 from h where rank = 1),
w as (select h.*, lat1, lon1, {weight} as w from h join f using (query_id) where rank <= 10),
c as (select query_id, q_lat, q_lon, lat1, lon1, coalesce(sum(w * radians((r_lon - lon1 + 180) - 360 * floor((r_lon - lon1 + 180) / 360) - 180)) / nullif(sum(w), 0), 0) as x,
    coalesce(sum(w * radians(r_lat - lat1)) / nullif(sum(w), 0), 0) as y from w group by 1, 2, 3, 4, 5),
est as (select query_id, q_lat, q_lon, lat1 + degrees(y) as lat, lon1 + degrees(x) as lon from c)
select query_id, round(lat, 8) as lat, round(lon, 8) as lon, round({metres_sql("q_lat", "q_lon", "lat", "lon")}, 3) as error_m from est"""


@query("l2_centroid", _centroid_sql("greatest(sim, 0)"))
def l2_centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = localize.weighted_centroid(Scene(spark, d, FULL).hits)
    return rows.select("query_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("error_m", 3).alias("error_m"))


@query("l2_softmax_centroid", _centroid_sql("exp(20.0 * (sim - max(sim) over (partition by query_id)))"))
def l2_softmax_centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = localize.weighted_centroid(Scene(spark, d, FULL).hits, temperature=20.0)
    return rows.select("query_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("error_m", 3).alias("error_m"))


@query("l3_clusters")
def l3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cluster centroid, snap and gated estimate of every query."""
    return localize.clustered(Scene(spark, d, FULL).hits)


@query("l7_midpoint_baseline", f"with {hits_sql()}, c as (select avg(lat) as lat, avg(lon) as lon from b) select q.image_id as query_id, round({metres_sql('q.lat', 'q.lon', 'c.lat', 'c.lon')}, 3) as error_m from q cross join c")
def l7_midpoint_baseline(spark: SparkSession, d: str) -> DataFrame:
    images = stage(views.images(spark, d, "lat", "lon", "split"), "images")
    return localize.midpoint_baseline(evaluation.queries_of(images), evaluation.references_of(images)).withColumn("error_m", F.round("error_m", 3))


@query("l7_random_baseline")
def l7_random_baseline(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d)
    drawn = evaluation.random_rankings(s.queries, s.references, 1)
    return localize.random_baseline(evaluation.hits(drawn, s.queries, s.references))


def utm_sql(lat: str, lon: str, zone: str) -> tuple[str, str]:
    """Easting and northing by the same series."""
    n = geo.WGS84_F / (2 - geo.WGS84_F)
    a = geo.UTM_K0 * geo.WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    t, dl = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))", f"radians({lon} - ({zone} * 6 - 183))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + pow({t}, 2)))"
    x = " + ".join([eta, *[f"{c!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(alpha, 1)]])
    y = " + ".join([xi, *[f"{c!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(alpha, 1)]])
    return f"({geo.UTM_E0!r} + {a!r} * ({x}))", f"({a!r} * ({y}))"


def _utm_images_sql() -> str:
    x, y = utm_sql("lat", "lon", "zone")
    zones = "select image_id, lat, lon, least(floor((lon + 180) / 6) + 1, 60)::int as zone from m where placed and abs(lat) < 84"
    return f"with {IMAGES_SQL}, z as ({zones}) select image_id, zone, round({x}, 2) as easting, round({y}, 2) as northing from z"


@query("g6_utm", _utm_images_sql())
def g6_utm(spark: SparkSession, d: str) -> DataFrame:
    """UTM coordinates of every placed image in its own zone."""
    rows = views.images(spark, d, "lat", "lon").where("placed and abs(lat) < 84")
    x, y = utm_xy("lat", "lon", utm_zone("lon"))
    return rounded(rows.select("image_id", utm_zone("lon").alias("zone"), x.alias("easting"), y.alias("northing")), 2)
