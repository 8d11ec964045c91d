"""Queries on stored variants, districts, projected distances, detections and adapters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import adapter, dataset, descriptors, embedding, evaluation, hierarchy, nearby, rerank
from waymark.plans.analyses import DISTRICT_SQL, rounded
from waymark.plans.numerics import DIM
from waymark.plans.records import _DETECTIONS_SQL, _detections
from waymark.plans.registry import Catalogue
from waymark.plans.reranking import _positions, utm_sql
from waymark.plans.retrieval import Scene
from waymark.sources import formats, lists, views
from waymark.sources.staging import folder, stage
from waymark.sources.tables import table
from waymark.sources.views import IMAGES_SQL, RANKINGS_SQL, hits_sql

catalogue = Catalogue()
query = catalogue.query
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql


@query("s9_guarded_lists", f"with {RANKINGS_SQL} select 'net' as variant, count(*) as n, count(distinct query_id) as n_queries, max(rank)::bigint as width from r union all "
       f"select 'net_fullref' as variant, count(*), count(distinct query_id), max(rank)::bigint from (select * from r where rank <= 5)")
def s9_guarded_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two variants of the lists, saved and loaded under the settings they were made with."""
    root, settings = folder(spark, "variants"), {"k": 10, "metric": "cosine"}
    base = stage(views.rankings(spark, d), "lists")
    lists.save_lists(base, root, lists.list_name("net"), settings)
    lists.save_lists(base.where("rank <= 5"), root, lists.list_name("net", full_reference=True), settings)
    out = []
    for full in (False, True):
        rows = lists.load_lists(spark, root, settings, "net", full_reference=full)
        out.append(rows.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_queries"), F.max("rank").alias("width")).select(F.lit(lists.list_name("net", full_reference=full)).alias("variant"), "*"))
    return out[0].unionByName(out[1])


@query(
    "j15_district_metrics",
    f"""with {IMAGES_SQL}, {DISTRICT_SQL}, c as (select district_id, count(*) as n_images, count(*) filter (where split = 'query') as n_queries, count(distinct sequence_id) as n_sequences from m join district using (image_id) group by 1)
select d.district_id, d.district_name, coalesce(n_images, 0) as n_images, coalesce(n_queries, 0) as n_queries, coalesce(n_sequences, 0) as n_sequences from districts d left join c using (district_id)""",
)
def j15_district_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every district with the images that lie in it; districts without any keep their row with zeros."""
    images = stage(views.images(spark, d, "lat", "lon", "split", "sequence_id").where("placed"), "images")
    where = hierarchy.containing_region(images, table(spark, d, "districts")).where("district_id is not null")
    metrics = images.join(where, "image_id").groupBy("district_id").agg(F.count("*").alias("n_images"), F.count_if(F.col("split") == "query").alias("n_queries"), F.countDistinct("sequence_id").alias("n_sequences"))
    rows = table(spark, d, "districts").select("district_id", "district_name").join(metrics, "district_id", "left")
    return rows.fillna(0, ["n_images", "n_queries", "n_sequences"])


@query(
    "a13_district_density",
    f"""with {IMAGES_SQL}, {DISTRICT_SQL}, c as (select district_id, count(*) filter (where split = 'database') as n_database, count(*) filter (where split = 'query') as n_queries from m join district using (image_id) group by 1)
select d.district_id, n_database, n_queries, round(n_database / area_km2, 6) as per_km2, round(n_database / nullif(n_queries, 0), 6) as per_query from districts d join c using (district_id)""",
)
def a13_district_density(spark: SparkSession, d: str) -> DataFrame:
    """Database images of a district, per square kilometre and per query image."""
    images = stage(views.images(spark, d, "lat", "lon", "split").where("placed"), "images")
    where = hierarchy.containing_region(images, table(spark, d, "districts")).where("district_id is not null")
    per = images.join(where, "image_id").groupBy("district_id").agg(F.count_if(F.col("split") == "database").alias("n_database"), F.count_if(F.col("split") == "query").alias("n_queries"))
    rows = table(spark, d, "districts").select("district_id", "area_km2").join(per, "district_id")
    return rounded(rows.select("district_id", "n_database", "n_queries", (F.col("n_database") / F.col("area_km2")).alias("per_km2"), F.try_divide("n_database", "n_queries").alias("per_query")))


def _utm_distance(zone, lat1: str, lon1: str, lat2: str, lon2: str):
    (x1, y1), (x2, y2) = geo.utm_xy(lat1, lon1, zone), geo.utm_xy(lat2, lon2, zone)
    return F.hypot(x1 - x2, y1 - y2)


def _utm_near_sql(left: str, right: str, on: str, radius: float, keys: tuple[str, str], spread: float) -> str:
    """Pairs of two tables within ``radius`` metres in the zone of the left position."""
    x1, y1 = utm_sql("lat1", "lon1", "zone")
    x2, y2 = utm_sql("lat2", "lon2", "zone")
    return f"""c as (select a.image_id as {keys[0]}, b.image_id as {keys[1]}, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2, least(floor((a.lon + 180) / 6) + 1, 60)::int as zone
  from {left} a join {right} b on b.lat between a.lat - {spread} and a.lat + {spread} and abs((((b.lon - a.lon + 180) % 360) + 360) % 360 - 180) * cos(radians(a.lat)) <= {2 * spread} and {on}),
u as (select {keys[0]}, {keys[1]}, sqrt(pow({x1} - ({x2}), 2) + pow({y1} - ({y2}), 2)) as d_m from c)
select {keys[0]}, {keys[1]}, round(d_m, 3) as d_m from u where d_m <= {radius}"""


@query("j2_utm_pairs", f"with {hits_sql()}, {_utm_near_sql('q', 'b', 'true', 50, ('query_id', 'ref_id'), 0.0006)}")
def j2_utm_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Query-database pairs within 50 m in the plane of the query's UTM zone."""
    s = Scene(spark, d)
    # The projection's scale lies between 0.9996 and 1.001 within a zone.
    pairs = nearby.near_pairs(s.queries, s.references, 50.0 * 1.002, carry=("lat", "lon"))
    d_m = _utm_distance(geo.utm_zone("left_lon"), "left_lat", "left_lon", "right_lat", "right_lon")
    return pairs.withColumn("d_m", d_m).where("d_m <= 50").select(F.col("left_id").alias("query_id"), F.col("right_id").alias("ref_id"), F.round("d_m", 3).alias("d_m"))


@query(
    "j3_utm_pairs",
    f"with {IMAGES_SQL}, t as (select * from m where split = 'train' and placed and sequence_id is not null), "
    + _utm_near_sql("t", "t", "a.image_id < b.image_id and a.sequence_id <> b.sequence_id and coalesce(least(abs(a.heading - b.heading), 360 - abs(a.heading - b.heading)) <= 90, true)", 10, ("image_id_a", "image_id_b"), 0.0002),
)
def j3_utm_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Positive pairs of train within 10 m in the plane of the smaller id's UTM zone."""
    train = stage(views.images(spark, d, "sequence_id", "lat", "lon", "compass_angle", "split").where("split = 'train' and placed and sequence_id is not null"), "train")
    pairs = nearby.near_pairs(train, train, 10.0 * 1.002, carry=("sequence_id", "heading", "lat", "lon"))
    ok = (F.col("left_id") < F.col("right_id")) & (F.col("left_sequence_id") != F.col("right_sequence_id")) & geo.heading_matches("left_heading", "right_heading", 90)
    d_m = _utm_distance(geo.utm_zone("left_lon"), "left_lat", "left_lon", "right_lat", "right_lon")
    return pairs.where(ok).withColumn("d_m", d_m).where("d_m <= 10").select(F.col("left_id").alias("image_id_a"), F.col("right_id").alias("image_id_b"), F.round("d_m", 3).alias("d_m"))


@query(
    "local_hours",
    f"""with {IMAGES_SQL} select floor((captured_at / 1000.0 + floor(lon / 15 + 0.5) * 3600) / 3600 - 24 * floor((captured_at / 1000.0 + floor(lon / 15 + 0.5) * 3600) / 86400)) as hour, count(*) as n from m where captured_at is not null and placed group by 1""",
)
def local_hours(spark: SparkSession, d: str) -> DataFrame:
    """Images by hour of the day, in the nautical time zone of their position."""
    rows = views.images(spark, d, "captured_at", "lat", "lon").where("captured_at is not null and placed")
    hours = (F.col("captured_at") / 1000 + F.floor(F.col("lon") / 15 + 0.5) * 3600) / 3600
    return rows.groupBy(F.floor(F.pmod(hours, F.lit(24.0))).cast("double").alias("hour")).agg(F.count("*").alias("n"))


@query(
    "a32_detection_shares",
    f"""with {_DETECTIONS_SQL}, t as (select image_id, sum(n) filter (where n > 0) as total from d group by 1)
select count(*) as n_images, round(avg((coalesce(total, 0) > 0)::int), 6) as share_with, round(avg(coalesce(total, 0)), 6) as mean_n, median(coalesce(total, 0))::double as median_n from t""",
)
def a32_detection_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of images with a detection, mean and median number of detections."""
    total = F.aggregate(F.map_values("counts"), F.lit(0), lambda s, n: s + F.greatest(n, F.lit(0)))
    return rounded(_detections(spark, d).agg(F.count("*").alias("n_images"), F.avg((total > 0).cast("double")).alias("share_with"), F.avg(total).alias("mean_n"), F.median(total).alias("median_n")))


@query("a32_top_classes", f"with {_DETECTIONS_SQL} select class, sum(n)::bigint as n_total, round(avg((n > 0)::int), 6) as image_share from d group by 1 order by n_total desc, class limit 30")
def a32_top_classes(spark: SparkSession, d: str) -> DataFrame:
    """The 30 most frequent classes (a report) and the share of images that show them."""
    rows = _detections(spark, d).select(F.explode("counts").alias("class", "n"))
    return rows.groupBy("class").agg(F.sum("n").alias("n_total"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("image_share")).orderBy(F.desc("n_total"), "class").limit(30)


@query("j16_parameter_grid", f"with {hits_sql()} select w::int as width, k::int as k, count(*) filter (where rank <= k and d_m <= w)::bigint as n_hits from h, unnest([5, 25, 100]) as a(w), unnest([1, 5, 10]) as c(k) group by 1, 2")
def j16_parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of two short parameter lists, counted in one pass over the hits."""
    widths, depths = (spark.createDataFrame([(v,) for v in values], f"{name} int") for name, values in (("width", (5, 25, 100)), ("k", (1, 5, 10))))
    cells = [(r["width"], r["k"]) for r in widths.crossJoin(depths).collect()]  # nine rows
    counted = [F.struct(F.lit(w).alias("width"), F.lit(k).alias("k"), F.count_if((F.col("rank") <= k) & (F.col("d_m") <= w)).alias("n_hits")) for w, k in cells]
    return Scene(spark, d).hits.agg(F.array(*counted).alias("cells")).select(F.inline("cells"))


@query(
    "t2_flat_queries",
    f"with {IMAGES_SQL}, q as (select * from m where split = 'query' and placed), any_pano as (select coalesce(bool_or(is_pano), false) as yes from q) select image_id from q, any_pano where yes and not coalesce(is_pano, false)",
)
def t2_flat_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries without panoramas: a separate evaluation only if there is a panorama at all, else no rows."""
    q = stage(evaluation.queries_of(views.images(spark, d, "lat", "lon", "split", "is_pano")).select("image_id", F.coalesce("is_pano", F.lit(False)).alias("pano")), "queries")
    return q.where(~F.col("pano") & q.agg(F.coalesce(F.bool_or("pano"), F.lit(False))).scalar()).select("image_id")


@query("embed_resume", "with i as (select distinct image_id from metadata) select count(*) as n_images, count(*) as n_embedded, count(*) filter (where image_id % 3 = 0) as n_before from i")
def embed_resume(spark: SparkSession, d: str) -> DataFrame:
    """Encoding taken up again: a first run stopped after a part of the images, the second does the rest."""
    out = folder(spark, "encoded")
    content = table(spark, d, "metadata").select("image_id").distinct().select("image_id", F.encode(F.col("image_id").cast("string"), "utf-8").alias("content"))
    before = embedding.resume(content.where("image_id % 3 = 0"), embedding.HashEmbedder, out).count()
    done = embedding.resume(content, embedding.HashEmbedder, out)
    return done.agg(F.count("*").alias("n_images"), F.countDistinct("image_id").alias("n_embedded")).withColumn("n_before", F.lit(before).cast("long"))


@query("place_slugs", "select district_id, regexp_replace(regexp_replace(strip_accents(replace(replace(replace(replace(lower(split_part(district_name, ',', 1)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from districts")
def place_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "districts").select("district_id", formats.place_slug("district_name").alias("slug"))


@query("x6_adapter")
def x6_adapter(spark: SparkSession, d: str) -> DataFrame:
    """A linear adapter trained on triplets of train and judged on validation sequences, against the identity.

    Anchors and positives are pairs within 10 m of two sequences, negatives 75 % from the
    ring and 25 % from anywhere. At most 20,000 triplets and 2,000 validation vectors,
    by hash, are trained on at the driver (a bound of the training, as documented).
    """
    most, judged = 20_000, 2_000
    train = stage(views.images(spark, d, "sequence_id", "lat", "lon", "compass_angle", "split").where("split = 'train' and placed and sequence_id is not null"), "train")
    vectors = stage(descriptors.clean(table(spark, d, "descriptors"), DIM).join(train.select("image_id", "sequence_id", "lat", "lon"), "image_id"), "vectors")
    held = F.pmod(F.xxhash64("sequence_id"), F.lit(5)) == 0
    fit, validation = stage(vectors.where(~held), "fit"), vectors.where(held)
    pairs = nearby.near_pairs(fit, fit, 25.0, carry=("sequence_id",)).where("left_sequence_id <> right_sequence_id").groupBy(F.col("left_id").alias("anchor_id")).agg(F.min(F.struct("d_m", "right_id")).alias("p"))
    triplets = pairs.select("anchor_id", F.col("p.right_id").alias("positive_id")).join(dataset.hard_negatives(fit.select("image_id", "lat", "lon")).select("anchor_id", "negative_id"), "anchor_id")
    chosen = triplets.orderBy(F.xxhash64("anchor_id"), "anchor_id").limit(most)
    for side in ("anchor", "positive", "negative"):
        chosen = chosen.join(fit.select(F.col("image_id").alias(f"{side}_id"), F.col("vec").alias(side)), f"{side}_id")
    rows = chosen.orderBy("anchor_id").toPandas()
    some = validation.orderBy(F.xxhash64("image_id"), "image_id").limit(judged).orderBy("image_id").toPandas()
    if not len(rows) or len(some) < 2:
        return spark.createDataFrame([], "n_triplets long, n_validation long, epochs int, before double, after double, verdict string")
    x = np.stack(some["vec"].to_numpy())
    names = some["sequence_id"].to_numpy()
    at = np.radians(some[["lat", "lon"]].to_numpy())
    h = np.sin((at[:, None, 0] - at[None, :, 0]) / 2) ** 2 + np.cos(at[:, None, 0]) * np.cos(at[None, :, 0]) * np.sin((at[:, None, 1] - at[None, :, 1]) / 2) ** 2
    near = (2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h))) <= 50) & (names[:, None] != names[None])
    ask, ref = np.arange(0, len(x), 2), np.arange(1, len(x), 2)
    right = [set(np.flatnonzero(near[i][ref]).tolist()) for i in ask]
    best, history = adapter.train_adapter(*(np.stack(rows[c].to_numpy()) for c in ("anchor", "positive", "negative")), validate=lambda a: adapter.mini_recall(a, x[ask], x[ref], right))
    out = spark.createDataFrame([(len(rows), len(some), len(history) - 1, history[0], adapter.mini_recall(best, x[ask], x[ref], right))], "n_triplets long, n_validation long, epochs int, before double, after double")
    return out.withColumn("verdict", adapter.adapter_verdict(F.col("before"), F.col("after")))


@query("r1_stored_variant")
def r1_stored_variant(spark: SparkSession, d: str) -> DataFrame:
    """The lists of a sequence window of 3, made, stored as the variant ``net_seq3`` and loaded by name."""
    root, settings = folder(spark, "variants"), {"k": 10, "metric": "cosine"}
    base = stage(views.rankings(spark, d), "lists")
    lists.save_lists(rerank.sequence_window(base, _positions(spark, d), 3), root, lists.list_name("net", window=3), settings)
    return rounded(lists.load_lists(spark, root, settings, "net", window=3))
