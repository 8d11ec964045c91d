"""Queries on descriptors, exact search, splits and statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import audit, dataset, descriptors, evaluation, search, stats
from waymark.operators.hierarchy import containing_region
from waymark.plans.analyses import DISTRICT_SQL, rounded
from waymark.plans.registry import Catalogue
from waymark.plans.retrieval import _HARD, FULL, Scene, near_sql
from waymark.sources import views
from waymark.sources.staging import stage
from waymark.sources.tables import table, trimmed
from waymark.sources.views import IMAGES_SQL, RANKINGS_SQL, hits_sql, metres_sql

catalogue = Catalogue()
query = catalogue.query
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql

DIM = 64
#: Unit vectors of the usable descriptors.
VECTORS_SQL = """v0 as (
  select image_id, max(vec)::double[] as vec from descriptors
  where len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0 group by 1),
v as (select image_id, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) as vec from v0)"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return stage(descriptors.clean(table(spark, d, "descriptors"), DIM), "unit")


@query(
    "k1_topk",
    f"""with {VECTORS_SQL}, s as (select a.image_id as query_id, b.image_id as ref_id, round({_dot("a.vec", "b.vec")}, 9) as sim from v a join v b on a.image_id % 50 = 0 and a.image_id <> b.image_id),
t as (select *, row_number() over (partition by query_id order by sim desc, ref_id) as rank from s) select query_id, rank, ref_id, round(sim, 6) as sim from t where rank <= 10""",
)
def k1_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact search: queries are the images whose id is divisible by 50, references all images."""
    v = _vectors(spark, d)
    return search.exact_topk(v.where(F.col("image_id") % 50 == 0), v, 10).withColumn("sim", F.round("sim", 6))


_TOP_SQL = f"""with {VECTORS_SQL}, a as (select * from v {{0}}),
s as (select a.image_id as query_id, b.image_id as ref_id, round({_dot("a.vec", "b.vec")}, 9) as sim from a join v b on a.image_id <> b.image_id),
t as (select *, row_number() over (partition by query_id order by sim desc, ref_id) as rank from s) select query_id, rank, ref_id, round(sim, 6) as sim from t where rank <= {{1}}"""


@query("k3_blockwise", _TOP_SQL.format("where image_id % 50 = 0", 20))
def k3_blockwise(spark: SparkSession, d: str) -> DataFrame:
    """Exact search over a grid of small blocks of queries and references: merged, they give the same lists."""
    v = _vectors(spark, d)
    return search.exact_topk(v.where(F.col("image_id") % 50 == 0), v, 20, block=0, cell_queries=64, cell_references=2048).withColumn("sim", F.round("sim", 6))


@query("k4_locator_topk", _TOP_SQL.format("order by image_id limit 1", 50))
def k4_locator_topk(spark: SparkSession, d: str) -> DataFrame:
    """One query against everything, as the locator asks."""
    v = _vectors(spark, d)
    return search.exact_topk(v.orderBy("image_id").limit(1), v, 50).withColumn("sim", F.round("sim", 6))


@query(
    "k7_argmax",
    f"""with {VECTORS_SQL}, s as (select a.image_id as query_id, b.image_id as ref_id, round({_dot("a.vec", "b.vec")}, 9) as sim from v a join v b on a.image_id % 50 = 0 and a.image_id <> b.image_id)
select query_id, arg_min(ref_id, {{'s': -sim, 'r': ref_id}}) as ref_id from s group by 1""",
)
def k7_argmax(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return search.exact_topk(v.where(F.col("image_id") % 50 == 0), v, 1).select("query_id", "ref_id")


@query(
    "l8_locate",
    f"""with {VECTORS_SQL}, {IMAGES_SQL}, a as (select * from v where image_id % 50 = 0), g as (select v.* from v join m using (image_id) where split in ('database', 'train') and placed),
s as (select a.image_id as query_id, g.image_id as ref_id, round({_dot("a.vec", "g.vec")}, 9) as sim from a join g on a.image_id <> g.image_id),
t as (select *, row_number() over (partition by query_id order by sim desc, ref_id) as rank from s qualify rank <= 10),
p as (select t.*, m.lat, m.lon from t join m on m.image_id = t.ref_id),
o as (select p.*, o.lat as lat1, o.lon as lon1 from p join p o on o.query_id = p.query_id and o.rank = 1),
l as (select query_id, any_value(lat1) as lat, any_value(lon1) as lon, max(sim) filter (where rank = 1) as confidence, max(sim) filter (where rank = 2) as second, max({metres_sql("lat1", "lon1", "lat", "lon")}) as spread_m from o group by 1)
select a.image_id as query_id, null::varchar as error, round(lat, 6) as lat, round(lon, 6) as lon, round(confidence, 6) as confidence, round(confidence - second, 6) as margin, round(spread_m, 3) as spread_m from a left join l on l.query_id = a.image_id""",
)
def l8_locate(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates for the images whose id is divisible by 50, from all placed train and database images."""
    v = _vectors(spark, d)
    images = stage(views.images(spark, d, "lat", "lon", "split"), "images")
    refs = v.join(evaluation.references_of(images, FULL).select("image_id"), "image_id", "left_semi")
    found = search.locate(v.where(F.col("image_id") % 50 == 0), refs, images)
    return found.withColumns({c: F.round(c, 3 if c == "spread_m" else 6) for c in ("lat", "lon", "confidence", "margin", "spread_m")})


@query(
    "v3_norms",
    """with d as (select vec, len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 as ok from descriptors),
n as (select vec, ok, case when ok then sqrt(coalesce(list_sum(list_transform(vec, lambda x: x::double * x::double)), 0)) end as n from d)
select count(*) as n, count(*) filter (where vec is null) as n_null, count(*) filter (where vec is not null and not ok) as n_not_finite, count(*) filter (where n = 0) as n_zero,
  round(min(n), 6) as min_norm, round(avg(n), 6) as mean_norm, round(max(n), 6) as max_norm from n""",
)
def v3_norms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(descriptors.norm_report(table(spark, d, "descriptors")))


@query("v2_normalized", f"with {VECTORS_SQL} select image_id, round(vec[1], 6) as first, round(vec[64], 6) as last from v")
def v2_normalized(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.clean(table(spark, d, "descriptors"), DIM).select("image_id", F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[63], 6).alias("last"))


@query("v7_concat", f"with {VECTORS_SQL} select image_id, 128::int as dim, round(vec[1] / sqrt(2.0), 6) as first, round(vec[1] / sqrt(2.0), 6) as last from v")
def v7_concat(spark: SparkSession, d: str) -> DataFrame:
    """A descriptor next to its reverse, aligned by image."""
    v = _vectors(spark, d)
    both = descriptors.concat(v, v.select("image_id", F.reverse("vec").alias("vec")), required=v)
    return both.select("image_id", F.size("vec").alias("dim"), F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[127], 6).alias("last"))


@query("v4_pca")
def v4_pca(spark: SparkSession, d: str) -> DataFrame:
    """Variance of each of 16 components and its share."""
    p = descriptors.fit_pca(_vectors(spark, d), 16)
    return spark.createDataFrame([(i + 1, float(v), p.share) for i, v in enumerate(p.variances)], "component int, variance double, total_share double")


@query("v5_whitened")
def v5_whitened(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return descriptors.apply_projection(v, descriptors.fit_pca(v, 16, whiten=True))


@query("v6_projection_check")
def v6_projection_check(spark: SparkSession, d: str) -> DataFrame:
    """Projections fitted on everything and on a seeded sample of half the images, compared by cosine."""
    v = _vectors(spark, d)
    whole, half = descriptors.fit_pca(v, 8), descriptors.fit_pca(v, 8, fit_images=max(1, v.count() // 2))
    return descriptors.mean_cosine(descriptors.apply_projection(v, whole), descriptors.apply_projection(v, half))


@query(
    "v8_adapter",
    f"""with {VECTORS_SQL}, w as (select vec, list_concat([0.8 * vec[1] - 0.6 * vec[2], 0.6 * vec[1] + 0.8 * vec[2]], vec[3:]) as turned from v),
c as (select {_dot("vec", "turned")} / sqrt({_dot("turned", "turned")}) as c from w) select count(*) as n, round(min(c), 6) as min_cosine, round(avg(c), 6) as mean_cosine from c""",
)
def v8_adapter(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine between descriptors and their image under a rotation of the first two axes."""
    v = _vectors(spark, d)
    w = np.eye(DIM)
    w[:2, :2] = [[0.8, -0.6], [0.6, 0.8]]
    return rounded(descriptors.mean_cosine(v, descriptors.apply_adapter(v, descriptors.LinearAdapter(w, np.zeros(DIM)))))


@query(
    "x9_stored_similarities",
    f"""with {RANKINGS_SQL}, {VECTORS_SQL}, g as (select abs({_dot("a.vec", "b.vec")} - sim) as gap from r join v a on a.image_id = r.query_id join v b on b.image_id = r.ref_id where sim is not null)
select count(*) as n, count(*) filter (where gap > 1e-4) as n_off, round(max(gap), 6) as max_gap from g""",
)
def x9_stored_similarities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(descriptors.stored_similarity_gap(views.rankings(spark, d), _vectors(spark, d)))


@query(
    "x4_val_halves",
    f"""with {IMAGES_SQL}, s as (select distinct sequence_id from m where split = 'train' and sequence_id is not null),
n as (select sequence_id, row_number() over (order by sequence_id) as i, count(*) over () as total from s)
select sequence_id, 'database' as half from n where i <= greatest(1, total // 2) union all select sequence_id, 'query' from n where i > greatest(1, total // 2) or total = 1""",
)
def x4_val_halves(spark: SparkSession, d: str) -> DataFrame:
    return dataset.validation_halves(views.images(spark, d, "sequence_id", "split").where("split = 'train'"))


@query(
    "x5_triplet_bands",
    f"""with {IMAGES_SQL}, t as (select * from m where split = 'train' and placed),
p as (select a.image_id, {metres_sql("a.lat", "a.lon", "b.lat", "b.lon")} as d_m from t a join t b on b.lat between a.lat - 0.001 and a.lat + 0.001 and a.image_id <> b.image_id
  where {metres_sql("a.lat", "a.lon", "b.lat", "b.lon")} <= 100)
select image_id, count(*) filter (where d_m <= 25) as n_blocked, count(*) filter (where d_m > 25) as n_hard from p group by 1""",
)
def x5_triplet_bands(spark: SparkSession, d: str) -> DataFrame:
    train = stage(views.images(spark, d, "lat", "lon", "split").where("split = 'train' and placed"), "train")
    return dataset.triplet_bands(train)


@query("x5_hard_negatives")
def x5_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    train = stage(views.images(spark, d, "lat", "lon", "split").where("split = 'train' and placed"), "train")
    return dataset.hard_negatives(train)


@query("x1_draw_split")
def x1_draw_split(spark: SparkSession, d: str) -> DataFrame:
    """The seeded draw over the listed sequences."""
    ids = [r[0] for r in table(spark, d, "split_lists").where("sequence_id is not null").select(trimmed("sequence_id")).distinct().collect()]
    lists = dataset.draw_split(ids, 42, 0.6, 0.2)
    return spark.createDataFrame([(s, split) for split, names in lists.items() for s in names], "sequence_id string, split string")


@query("x8_random_split")
def x8_random_split(spark: SparkSession, d: str) -> DataFrame:
    """Sequences a random split per image would tear: images, splits."""
    rows = dataset.random_split(views.images(spark, d, "sequence_id"), {"train": 0.6, "database": 0.2, "query": 0.2})
    return audit.split_consistency(rows)


_FLAGS_SQL = f"""with {hits_sql("'database', 'train'")}, {near_sql(25)},
s as (select query_id, min(d_m) as nearest from n group by 1), g as (select query_id, min(rank) filter (where d_m <= 25) as best from h group by 1),
f as (select q.image_id as query_id, q.sequence_id, s.nearest, g.best from q left join s on s.query_id = q.image_id left join g on g.query_id = q.image_id)
"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d, FULL)
    return evaluation.per_query(s.queries, s.near(25.0), s.hits, thresholds=(25.0,)).where("sequence_id is not null")


@query(
    "a23_sequence_sums",
    _FLAGS_SQL
    + """select sequence_id, count(*) filter (where nearest <= 25) as n_solvable, count(*) filter (where nearest <= 25 and best <= 1) as hits_1,
  count(*) filter (where nearest <= 25 and best <= 5) as hits_5, count(*) filter (where nearest <= 25 and best <= 10) as hits_10 from f where sequence_id is not null group by 1""",
)
def a23_sequence_sums(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_sums(_flags(spark, d), "sequence_id")


@query("a24_bootstrap")
def a24_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap(stage(stats.cluster_sums(_flags(spark, d), "sequence_id"), "sums"), "sequence_id")


@query("a25_paired")
def a25_paired(spark: SparkSession, d: str) -> DataFrame:
    """Hits against the full reference with and without twins, on identical draws."""
    s = Scene(spark, d, FULL)
    near = s.near(25.0)
    sums = [
        stage(stats.cluster_sums(evaluation.per_query(s.queries, near, s.hits, truth, (25.0,)).where("sequence_id is not null"), "sequence_id"), "sums")
        for truth in (None, evaluation.not_twin())
    ]
    return stats.paired_difference(*sums, "sequence_id")


@query(
    "a29_rank_correlation",
    _FLAGS_SQL
    + """, p as (select count(*) filter (where nearest is not null)::double as x, count(*)::double as y from f where sequence_id is not null group by sequence_id),
rk as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from p)
select count(*) as n, round(corr(rx, ry), 6) as rho from rk""",
)
def a29_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Solvable queries against queries, over sequences, with ties averaged."""
    per = _flags(spark, d).groupBy("sequence_id").agg(F.count("nearest_m").alias("x"), F.count("*").alias("y"))
    return rounded(stats.rank_correlation(stage(per, "per"), "x", "y"))


@query("a29_spearman")
def a29_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Exact rank correlation of image and sequence counts over the splits."""
    rows = audit.split_counts(views.images(spark, d, "sequence_id", "creator_id", "split")).where("split is not null").orderBy("split").collect()
    rho, p = stats.spearman_exact([r["n_images"] for r in rows], [r["n_sequences"] for r in rows])
    return spark.createDataFrame([(len(rows), rho, p)], "n int, rho double, p double")


@query(
    "a30_hard_drop",
    f"""with {hits_sql()}, {near_sql(25)}, hard as (select *, {_HARD} as ok from n), near as (select query_id from n group by 1),
best as (select query_id, min(rank) as best from h where d_m <= 25 group by 1),
c as (select (select count(*) from near) as n_solvable, (select count(*) from best where best = 1) as n_correct, (select count(distinct query_id) from hard where ok) as n_solvable_hard,
  (select coalesce(avg((not {_HARD})::int), 0.0) from h where rank = 1 and d_m <= 25) as duplicate_share),
x as (select *, n_correct::double / nullif(n_solvable, 0) as recall, n_correct * (1 - duplicate_share) / nullif(n_solvable_hard, 0) as expected_hard from c)
select n_solvable, n_correct, n_solvable_hard, round(duplicate_share, 6) as duplicate_share, round(recall, 6) as recall, round(expected_hard, 6) as expected_hard, round(recall - expected_hard, 6) as drop from x""",
)
def a30_hard_drop(spark: SparkSession, d: str) -> DataFrame:
    """The hard-drop identity at 25 m on the database protocol."""
    s = Scene(spark, d)
    near = s.near(25.0)
    flags = evaluation.per_query(s.queries, near, s.hits, thresholds=(25.0,))
    counts = flags.agg(F.count("nearest_m").alias("n_solvable"), F.count_if(F.col("rank_25") == 1).alias("n_correct"))
    hard = evaluation.solvable(near, evaluation.hard_hit()).agg(F.count("*").alias("n_solvable_hard"))
    first = s.hits.where("rank = 1 and d_m <= 25").agg(F.coalesce(F.avg((~evaluation.hard_hit()).cast("double")), F.lit(0.0)).alias("duplicate_share"))
    return rounded(stats.hard_drop(counts.withColumns({"n_solvable_hard": hard.scalar(), "duplicate_share": first.scalar()})))


@query(
    "a31_panorama",
    _FLAGS_SQL
    + """, o as (select coalesce(q.is_pano, false) as pano, coalesce(best = 1, false) as hit from f join q on q.image_id = f.query_id where nearest is not null),
c as (select count(*) as n_all, count(*) filter (where hit) as hits_all, count(*) filter (where not pano) as n_nopano, count(*) filter (where hit and not pano) as hits_nopano from o),
p as (select *, n_all - n_nopano as n_pano, (hits_all - hits_nopano)::double / nullif(n_all - n_nopano, 0) as p from c)
select n_all, hits_all, n_nopano, hits_nopano, n_pano, round(p, 6) as recall_pano, round(sqrt(p * (1 - p) / nullif(n_pano, 0)), 6) as std_error from p""",
)
def a31_panorama(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d, FULL)
    flags = evaluation.per_query(s.queries, s.near(25.0), s.hits, thresholds=(25.0,)).join(s.queries.select(F.col("image_id").alias("query_id"), F.coalesce("is_pano", F.lit(False)).alias("pano")), "query_id").where("nearest_m is not null")
    hit = F.coalesce(F.col("rank_25") == 1, F.lit(False))
    counts = flags.agg(F.count("*").alias("n_all"), F.count_if(hit).alias("hits_all"), F.count_if(~F.col("pano")).alias("n_nopano"), F.count_if(hit & ~F.col("pano")).alias("hits_nopano"))
    return rounded(stats.panorama_recall(counts))


@query(
    "a28_group_comparison",
    f"""with {IMAGES_SQL}, {DISTRICT_SQL}, c as (select district_id, split, count(*)::double as n from m join district using (image_id) where split is not null group by 1, 2),
b as (select district_id, max(n) as best from c group by 1)
select split, count(n) as n_groups, min(n) as min_value, max(n) as max_value, max(n) - min(n) as range, count(*) filter (where n = best) as n_wins from c join b using (district_id) group by 1""",
)
def a28_group_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Splits compared over districts by their number of images."""
    images = stage(views.images(spark, d, "lat", "lon", "split"), "images")
    where = containing_region(images, table(spark, d, "districts")).where("district_id is not null")
    counts = images.where("split is not null").join(where, "image_id").groupBy("district_id", "split").agg(F.count("*").cast("double").alias("n"))
    return stats.compare_groups(counts, "district_id", "split", "n")
