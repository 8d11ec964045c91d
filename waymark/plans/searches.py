"""Queries on exact search of all queries against the references, and on all ground truths at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import descriptors, evaluation, search
from waymark.plans.numerics import DIM, VECTORS_SQL, _dot
from waymark.plans.registry import Catalogue
from waymark.plans.retrieval import _FACING, _HARD, _TWIN, KS, THRESHOLDS, Scene, recall_sql
from waymark.sources import views
from waymark.sources.staging import stage
from waymark.sources.tables import table
from waymark.sources.views import IMAGES_SQL, metres_sql

catalogue = Catalogue()
query = catalogue.query
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql

#: Shares of the train sequences that join the reference, and the seed of their order.
FRACTIONS, SEED = (0.0, 0.25, 0.5, 1.0), "1"


class Gallery:
    """Cleaned vectors with the split and position of their images, staged once: the index that searches run on."""

    def __init__(self, spark: SparkSession, d: str):
        self.images = stage(views.images(spark, d, "lat", "lon", "split", "sequence_id").where("split is not null and placed"), "images")
        vectors = descriptors.clean(table(spark, d, "descriptors"), DIM)
        self.vectors = stage(vectors.join(self.images.select("image_id", "split", "sequence_id"), "image_id"), "gallery")
        self.queries = self.vectors.where("split = 'query'")

    def search(self, references: DataFrame, k: int) -> DataFrame:
        return search.exact_topk(self.queries, references, k)


_GALLERY_SQL = f"""{VECTORS_SQL}, {IMAGES_SQL}, g as (select v.image_id, v.vec, m.split, m.sequence_id, m.lat, m.lon from v join m using (image_id) where split is not null and placed)"""


def _search_sql(references: str, k: int) -> str:
    return f"""s as (select a.image_id as query_id, b.image_id as ref_id, round({_dot("a.vec", "b.vec")}, 9) as sim from g a join g b on a.split = 'query' and ({references}) and a.image_id <> b.image_id),
t as (select *, row_number() over (partition by query_id order by sim desc, ref_id) as rank from s qualify rank <= {k})"""


@query("k1_query_database", f"""with {_GALLERY_SQL}, {_search_sql("b.split = 'database'", 10)} select query_id, rank, ref_id, round(sim, 6) as sim from t""")
def k1_query_database(spark: SparkSession, d: str) -> DataFrame:
    """Every query image against the whole database split: the lists that recall is measured on."""
    g = Gallery(spark, d)
    return g.search(g.vectors.where("split = 'database'"), 10).withColumn("sim", F.round("sim", 6))


@query("k5_full_search", f"""with {_GALLERY_SQL}, {_search_sql("b.split in ('database', 'train')", 10)} select query_id, rank, ref_id, round(sim, 6) as sim from t""")
def k5_full_search(spark: SparkSession, d: str) -> DataFrame:
    """The full reference by merging: lists over the database and over train, searched apart."""
    g = Gallery(spark, d)
    parts = [g.search(g.vectors.where(F.col("split") == s), 10) for s in ("database", "train")]
    return search.merged_lists(parts[0].unionByName(parts[1]), 10).withColumn("sim", F.round("sim", 6))


_SHARE_SQL = f"case when split = 'database' then -1 when sequence_id is null then 1 else ('0x' || substr(md5(sequence_id || '|{SEED}'), 1, 12))::bigint::double / 281474976710656.0 end"


@query(
    "k6_fractions",
    f"""with {_GALLERY_SQL}, r as (select image_id, split, vec, lat, lon, {_SHARE_SQL} as share from g where split in ('database', 'train')),
f as (select unnest({list(FRACTIONS)}::double[]) as fraction),
q as (select image_id as query_id, vec, lat as q_lat, lon as q_lon from g where split = 'query'),
s as (select query_id, image_id as ref_id, share, round({_dot("q.vec", "r.vec")}, 9) as sim, {metres_sql("q_lat", "q_lon", "lat", "lon")} as d_m from q cross join r),
t as (select f.fraction, query_id, d_m, row_number() over (partition by f.fraction, query_id order by sim desc, ref_id) as rank from s join f on share < f.fraction or f.fraction = 1.0 qualify rank <= 10),
hit as (select fraction, query_id, min(rank) as best from t where d_m <= 25 group by 1, 2),
near as (select f.fraction, query_id, count(*) as n from s join f on share < f.fraction or f.fraction = 1.0 where d_m <= 25 group by 1, 2),
n as (select f.fraction, count(*) as n_references from r join f on share < f.fraction or f.fraction = 1.0 group by 1)
select f.fraction, any_value(n.n_references) as n_references, count(*) as n_queries, count(near.n) as n_solvable, median(near.n)::double as median_near,
  {", ".join(f"count(*) filter (where hit.best <= {k}) as hits_{k}" for k in KS)}
from f join n using (fraction) cross join q left join near on near.fraction = f.fraction and near.query_id = q.query_id left join hit on hit.fraction = f.fraction and hit.query_id = q.query_id group by 1""",
)
def k6_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Nested references: the database, then seeded fractions of the train sequences; each part is searched once.

    The lists of a fraction are the merge of its own part's with those before. Per
    fraction: references, solvable queries, median number of references within 25 m, hits at k.
    """
    g = Gallery(spark, d)
    u = F.conv(F.substring(F.md5(F.concat(F.col("sequence_id"), F.lit(f"|{SEED}"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    share = F.when(F.col("split") == "database", F.lit(-1.0)).otherwise(F.coalesce(u, F.lit(1.0)))
    refs = stage(g.vectors.where("split in ('database', 'train')").withColumn("share", share), "references")
    step = F.lit(len(FRACTIONS) - 1)
    for i in range(len(FRACTIONS) - 2, -1, -1):
        step = F.when(F.col("share") < FRACTIONS[i], F.lit(i)).otherwise(step)
    refs = refs.withColumn("step", F.when(F.col("split") == "database", F.lit(0)).otherwise(step))
    places = g.images.select("image_id", "lat", "lon")
    near = evaluation.near_pairs(places.join(g.queries.select("image_id"), "image_id"), places.join(refs.select("image_id", "step"), "image_id"), 25.0).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("ref_id"))
    near = stage(near.join(refs.select(F.col("image_id").alias("ref_id"), "step"), "ref_id"), "near")
    lists, out = None, None
    for i, fraction in enumerate(FRACTIONS):
        part = g.search(refs.where(F.col("step") == i), 10)
        lists = stage(part if lists is None else search.merged_lists(lists.unionByName(part), 10), "lists")
        best = lists.join(near.select("query_id", "ref_id"), ["query_id", "ref_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
        around = near.where(F.col("step") <= i).groupBy("query_id").agg(F.count("*").alias("n"))
        rows = g.queries.select(F.col("image_id").alias("query_id")).join(around, "query_id", "left").join(best, "query_id", "left")
        of = refs.where(F.col("step") <= i).agg(F.count("*")).scalar()
        row = rows.agg(F.count("*").alias("n_queries"), F.count("n").alias("n_solvable"), F.median("n").cast("double").alias("median_near"), *[F.count_if(F.col("best") <= k).alias(f"hits_{k}") for k in KS])
        row = row.select(F.lit(fraction).alias("fraction"), of.alias("n_references"), "*")
        out = row if out is None else out.unionByName(row)
    return out


#: Every ground truth: its column, its SQL, and whether panoramas are left out.
TRUTHS = {
    "all": (evaluation.any_hit, "true", False), "no_panoramas": (evaluation.any_hit, "true", True), "hard": (evaluation.hard_hit, _HARD, False),
    "heading": (evaluation.facing_hit, _FACING, False), "no_twins": (evaluation.not_twin, f"not {_TWIN}", False),
}


def _every_truth(s: Scene, found: DataFrame) -> DataFrame:
    """Recall under every ground truth from one pass over the lists and one over the neighbours."""
    near = s.near(max(THRESHOLDS)).groupBy("query_id").agg(*[F.min(F.when(truth(), F.col("d_m"))).alias(f"nearest_{t}") for t, (truth, _, _) in TRUTHS.items()])
    ranks = [F.min(F.when(truth() & (F.col("d_m") <= m), F.col("rank"))).alias(f"rank_{t}_{m:g}") for t, (truth, _, _) in TRUTHS.items() for m in THRESHOLDS]
    best = found.groupBy("query_id").agg(*ranks)
    rows = s.queries.select(F.col("image_id").alias("query_id"), F.coalesce("is_pano", F.lit(False)).alias("pano")).join(near, "query_id", "left").join(best, "query_id", "left")
    cells = []
    for t, (_, _, flat) in TRUTHS.items():
        kept = ~F.col("pano") if flat else F.lit(True)
        for m in THRESHOLDS:
            ok = kept & (F.col(f"nearest_{t}") <= m)
            for k in KS:
                cells.append(F.struct(F.lit(t).alias("truth"), F.lit(m).alias("threshold_m"), F.lit(k).alias("k"), F.count_if(kept).alias("n_queries"), F.count_if(ok).alias("n_solvable"), F.count_if(ok & (F.col(f"rank_{t}_{m:g}") <= k)).alias("n_hits")))
    out = rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return out.withColumn("recall", F.round(F.try_divide("n_hits", "n_solvable"), 6))


@query("a7_every_truth", " union all ".join(f"select '{t}' as truth, * from ({recall_sql(sql, keep='not coalesce(is_pano, false)' if flat else 'true')})" for t, (_, sql, flat) in TRUTHS.items()))
def a7_every_truth(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d)
    return _every_truth(s, s.hits)


@query("t6_every_truth")
def t6_every_truth(spark: SparkSession, d: str) -> DataFrame:
    """The random baseline of every ground truth."""
    s = Scene(spark, d)
    drawn = evaluation.random_rankings(s.queries, s.references, max(KS))
    return _every_truth(s, evaluation.hits(drawn, s.queries, s.references))
