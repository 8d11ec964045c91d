"""Analyses of the stored result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.operators import analysis, evaluation, hierarchy
from waymark.plans.registry import Catalogue
from waymark.plans.retrieval import FULL, Scene, near_sql
from waymark.sources.staging import stage
from waymark.sources.tables import table
from waymark.sources.views import hits_sql, metres_sql

catalogue = Catalogue()
query = catalogue.query
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql

#: Whole days between a query and its nearest reference in time.
CLASSES = (("same day", 0, 0), ("month", 1, 31), ("year", 32, 365), ("older", 366, None))
H, HF = hits_sql(), hits_sql("'database', 'train'")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_DIFFICULTY = f"""with {H}, {near_sql(25)},
p as (select query_id, count(*) as n_near, floor(min(abs(q_at - r_at) / 86400000.0))::bigint as min_days,
    bool_or(coalesce(least(abs(q_heading - r_heading), 360 - abs(q_heading - r_heading)) <= 90, true)) as heading_ok,
    coalesce(bool_or(q_creator = r_creator and abs(q_at - r_at) / 86400000.0 < 1), false) as same_day from n group by 1),
a as (select q.image_id as query_id, coalesce(n_near, 0) as n_near, min_days, coalesce(heading_ok, false) as heading_ok, coalesce(same_day, false) as same_day
  from q left join p on p.query_id = q.image_id)
"""


@query("a9_difficulty", _DIFFICULTY + "select * from a")
def a9_difficulty(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d)
    return analysis.difficulty(s.queries, s.near(25.0))


@query(
    "a10_recall_by_class",
    _DIFFICULTY
    + """, f as (select query_id, min(rank) filter (where d_m <= 25) as best from h group by 1),
x as (select case when min_days = 0 then 'same day' when min_days between 1 and 31 then 'month' when min_days between 32 and 365 then 'year' when min_days >= 366 then 'older' end as class,
    coalesce(best = 1, false) as hit from a left join f using (query_id) where n_near > 0)
select c.class, count(x.hit) as n, round(avg(x.hit::int), 6) as recall from (values ('same day'), ('month'), ('year'), ('older')) c(class) left join x using (class) group by 1""",
)
def a10_recall_by_class(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d)
    near = s.near(25.0)
    flags = evaluation.per_query(s.queries, near, s.hits, thresholds=(25.0,)).join(analysis.difficulty(s.queries, near), "query_id").where("n_near > 0")
    return rounded(analysis.recall_by_class(flags, CLASSES, F.col("min_days"), F.coalesce(F.col("rank_25") == 1, F.lit(False))))


@query(
    "a11_top1_origin",
    f"""with {HF}, t as (select *, abs(q_at - r_at) / 86400000.0 as days, q_creator = r_creator as same, least(abs(q_heading - r_heading), 360 - abs(q_heading - r_heading)) as turn from h where rank = 1 and d_m <= 25)
select count(*) as n, round(avg(coalesce(same, false)::int), 6) as same_creator_share, round(avg(coalesce(same and days <= 180, false)::int), 6) as duplicate_share, round(median(days), 6) as median_days,
  round(avg(coalesce(days < 1, false)::int), 6) as within_day_share, round(avg(coalesce(days > 365, false)::int), 6) as over_year_share, round(median(turn), 6) as median_turn from t""",
)
def a11_top1_origin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.top1_origin(Scene(spark, d, FULL).hits))


#: Ray casting over all edges of all rings; the least area, then the least id wins.
DISTRICT_SQL = """ring as (select district_id, area_km2, unnest(rings) as ring from districts),
edge as (select district_id, area_km2, unnest(list_zip(ring[:-2], ring[2:])) as e from ring),
ed as (select district_id, area_km2, e[1].lon as x1, e[1].lat as y1, e[2].lon as x2, e[2].lat as y2 from edge),
inside as (select image_id, district_id, area_km2 from m join ed on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
  where placed group by 1, 2, 3 having count(*) % 2 = 1),
district as (select image_id, arg_min(district_id, {'a': area_km2, 'i': district_id}) as district_id from inside group by 1)"""


@query(
    "a14_confusion_pairs",
    f"""with {HF}, {DISTRICT_SQL},
w as (select h.query_id, h.d_m, a.district_id as q_region, b.district_id as r_region from h left join district a on a.image_id = h.query_id left join district b on b.image_id = h.ref_id
  where rank = 1 and d_m > 25)
select q_region, r_region, count(*) as n, round(median(d_m), 3) as median_m, round(count(*) / (select count(*) from w), 6) as share
from w where q_region <> r_region group by 1, 2 order by n desc, q_region, r_region limit 20""",
)
def a14_confusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d, FULL)
    where = hierarchy.containing_region(s.images.where("placed"), table(spark, d, "districts"))
    wrong = s.hits.where("rank = 1 and d_m > 25")
    wrong = wrong.join(where.select(F.col("image_id").alias("query_id"), F.col("district_id").alias("q_region")), "query_id", "left")
    wrong = wrong.join(where.select(F.col("image_id").alias("ref_id"), F.col("district_id").alias("r_region")), "ref_id", "left")
    return analysis.confusion_pairs(wrong).withColumns({"median_m": F.round("median_m", 3), "share": F.round("share", 6)})


@query(
    "a13_district_table",
    f"""with {HF}, {near_sql(25)}, {DISTRICT_SQL},
s as (select distinct query_id from n), t as (select query_id from h where rank = 1 and d_m <= 25),
x as (select district.district_id, q.image_id, q.sequence_id, s.query_id is not null as ok, t.query_id is not null as hit
  from q left join district using (image_id) left join s on s.query_id = q.image_id left join t on t.query_id = q.image_id)
select district_id, count(*) as n_queries, count(distinct sequence_id) as n_sequences, count(*) filter (where ok) as n_solvable,
  round(count(*) filter (where ok)::double / count(*), 6) as solvable_share, round(count(*) filter (where ok and hit)::double / nullif(count(*) filter (where ok), 0), 6) as recall from x group by 1""",
)
def a13_district_table(spark: SparkSession, d: str) -> DataFrame:
    """Queries, solvable queries and R@1 per district; queries in none form the row with a null id."""
    s = Scene(spark, d, FULL)
    flags = evaluation.per_query(s.queries, s.near(25.0), s.hits, thresholds=(25.0,)).withColumnRenamed("query_id", "image_id")
    where = hierarchy.containing_region(s.queries, table(spark, d, "districts"))
    ok = F.col("nearest_m").isNotNull()
    return rounded(
        flags.join(where, "image_id").groupBy("district_id").agg(
            F.count("*").alias("n_queries"), F.countDistinct("sequence_id").alias("n_sequences"), F.count_if(ok).alias("n_solvable"),
            F.avg(ok.cast("double")).alias("solvable_share"), F.avg(F.when(ok, F.coalesce(F.col("rank_25") == 1, F.lit(False)).cast("double"))).alias("recall"),
        )
    )


_ERRORS = "round(quantile_cont({0}, 0.25), 3) as p25, round(quantile_cont({0}, 0.5), 3) as p50, round(quantile_cont({0}, 0.75), 3) as p75, round(quantile_cont({0}, 0.9), 3) as p90"


def _first(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the first hits, staged because the quantiles scan them a few times."""
    return stage(Scene(spark, d, FULL).hits.where("rank = 1").select("query_id", "d_m"), "first")


@query(
    "a15_error_quantiles",
    f"""with {HF} select count(*) as n, {_ERRORS.format("d_m")}, round(avg((d_m < 100)::int), 3) as below_100,
  round(avg((d_m >= 100 and d_m < 1000)::int), 3) as to_1000, round(avg((d_m >= 1000)::int), 3) as beyond_1000 from h where rank = 1 and d_m > 25""",
)
def a15_error_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.error_quantiles(_first(spark, d).where("d_m > 25")), 3)


@query(
    "a17_localization_stats",
    f"""with {HF} select count(*) as n, {_ERRORS.format("d_m")}, round(avg((d_m <= 10)::int), 3) as within_10, round(avg((d_m <= 25)::int), 3) as within_25,
  round(avg((d_m <= 50)::int), 3) as within_50, round(avg((d_m <= 100)::int), 3) as within_100 from h where rank = 1""",
)
def a17_localization_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.localization_stats(_first(spark, d).withColumnRenamed("d_m", "error_m")), 3)


@query(
    "a18_error_structure",
    f"""with {HF} select count(*) as n, {_ERRORS.format("d_m")}, """
    + ", ".join(f"round(avg((d_m <= {s})::int), 3) as within_{s}" for s in (50, 100, 250, 500, 1000, 2000))
    + " from h where rank = 1 and d_m > 25",
)
def a18_error_structure(spark: SparkSession, d: str) -> DataFrame:
    errors = _first(spark, d).where("d_m > 25").withColumnRenamed("d_m", "error_m")
    return rounded(analysis.localization_stats(errors, (50, 100, 250, 500, 1000, 2000)), 3)


_EDGES = tuple(round(10 ** (i / 8), 6) for i in range(41))


@query("a19_error_cdf", f"with {HF}, c as (select unnest([{', '.join(f'{e}::double' for e in _EDGES)}]) as edge_m) select edge_m, round(avg((d_m <= edge_m)::int), 6) as share from h cross join c where rank = 1 group by 1")
def a19_error_cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.error_cdf(Scene(spark, d, FULL).hits.where("rank = 1").withColumnRenamed("d_m", "error_m"), _EDGES))


_CONFIDENCE = f"""with {HF}, f as (select query_id, r_lat as lat1, r_lon as lon1 from h where rank = 1),
c as (select h.query_id, max(case when rank = 1 then sim end) as confidence, max(case when rank = 1 then sim end) - max(case when rank = 2 then sim end) as margin,
  avg(({metres_sql("lat1", "lon1", "r_lat", "r_lon")} <= 50)::int) as cohesion, max({metres_sql("lat1", "lon1", "r_lat", "r_lon")}) as spread_m from h join f using (query_id) group by 1),
s as (select h.query_id, h.sim as confidence, h.d_m <= 25 as correct from h where rank = 1)
"""


@query("w6_confidences", _CONFIDENCE + "select query_id, round(confidence, 6) as confidence, round(margin, 6) as margin, round(cohesion, 6) as cohesion, round(spread_m, 3) as spread_m from c")
def w6_confidences(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.confidences(Scene(spark, d, FULL).hits)
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("confidence", "margin", "cohesion")], F.round("spread_m", 3).alias("spread_m"))


_CURVE = _CONFIDENCE + """, k as (select query_id, count(*) over w as n_kept, sum(correct::int) over w as good, count(*) over () as total from s
  window w as (order by confidence desc nulls last, query_id rows unbounded preceding)),
curve as (select query_id, n_kept, n_kept / total as coverage, good / n_kept as precision from k)
"""  # fmt: skip


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d, FULL).hits.where("rank = 1").select("query_id", F.col("sim").alias("confidence"), (F.col("d_m") <= 25).alias("correct"))


@query("a20_rejection_curve", _CURVE + "select query_id, n_kept, round(coverage, 6) as coverage, round(precision, 6) as precision from curve")
def a20_rejection_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.rejection_curve(_scored(spark, d)))


@query(
    "a21_precision_at_coverage",
    _CURVE
    + """, g as (select *, lag(coverage) over (order by n_kept) as c0, lag(precision) over (order by n_kept) as p0 from curve)
select round(arg_min(precision, coverage) filter (where coverage >= 0.8), 6) as precision_80, round(arg_min(precision, coverage) filter (where coverage >= 0.5), 6) as precision_50,
  round(arg_min(precision, coverage) filter (where coverage >= 0.2), 6) as precision_20, round(sum((precision + p0) / 2 * (coverage - c0)), 6) as auc from g""",
)
def a21_precision_at_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.precision_at_coverage(analysis.rejection_curve(_scored(spark, d))))


@query(
    "a22_pairwise_auc",
    f"""with {HF}, c as (select query_id, sim, d_m <= 25 as correct from h)
select count(*) as n_pairs, round(avg(case when a.sim > b.sim then 1.0 when a.sim = b.sim then 0.5 else 0.0 end), 6) as auc
from c a join c b on a.query_id = b.query_id and a.correct and not b.correct""",
)
def a22_pairwise_auc(spark: SparkSession, d: str) -> DataFrame:
    hits = Scene(spark, d, FULL).hits
    return rounded(analysis.pairwise_auc(hits.select("query_id", "sim", (F.col("d_m") <= 25).alias("correct")), "sim"))


@query("l9_examples", f"""with {HF}, {near_sql(25)}, s as (select distinct query_id from n),
t as (select query_id, min(rank) filter (where d_m <= 25) as best, arg_min(d_m, rank) as first_m from h group by 1)
select query_id, case when best = 1 then 'success' when best > 1 then 'late' when s.query_id is not null then 'failure' else 'unsolvable' end as kind, round(first_m, 3) as first_m
from t left join s using (query_id)""")  # fmt: skip
def l9_examples(spark: SparkSession, d: str) -> DataFrame:
    """Every query with its kind of outcome at 25 m, for picking examples."""
    s = Scene(spark, d, FULL)
    flags = evaluation.per_query(s.queries, s.near(25.0), s.hits, thresholds=(25.0,))
    first = s.hits.groupBy("query_id").agg(F.min_by("d_m", "rank").alias("first_m"))
    kind = F.when(F.col("rank_25") == 1, "success").when(F.col("rank_25") > 1, "late").when(F.col("nearest_m").isNotNull(), "failure").otherwise("unsolvable")
    return flags.join(first, "query_id").select("query_id", kind.alias("kind"), F.round("first_m", 3).alias("first_m"))


@query("j5_list_distances", f"with {H} select query_id, max(d_m) filter (where rank = 1) is not null as has_first, round(avg(d_m), 3) as mean_m from h group by 1")
def j5_list_distances(spark: SparkSession, d: str) -> DataFrame:
    """Ranking joined to coordinates: mean distance of a list."""
    rows = Scene(spark, d).hits
    away = haversine("q_lat", "q_lon", "r_lat", "r_lon")
    return rows.groupBy("query_id").agg((F.count_if(F.col("rank") == 1) > 0).alias("has_first"), F.round(F.avg(away), 3).alias("mean_m"))
