"""Queries on file formats, records, roads, detections and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import local_xy, tile_x, tile_y
from waymark.operators import embedding, evaluation, examples, rerank, roads, skew
from waymark.plans.analyses import rounded
from waymark.plans.registry import Catalogue
from waymark.plans.retrieval import FULL, Scene, near_sql
from waymark.sources import formats, views
from waymark.sources.staging import folder, stage
from waymark.sources.tables import table
from waymark.sources.views import IMAGES_SQL, RANKINGS_SQL, hits_sql, metres_sql
from waymark.streaming import arrivals

catalogue = Catalogue()
query = catalogue.query
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql


_COLUMNS = "image_id, sequence_id, captured_at, lat, lon, compass_angle, is_pano, creator_id"


@query("s1_pruned_scan", "select image_id, lat, lon from metadata where lat > 60")
def s1_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """Three columns and a filter, both pushed into the Parquet scan."""
    return table(spark, d, "metadata").where("lat > 60").select("image_id", "lat", "lon")


@query("s3_csv_round_trip", f"with {IMAGES_SQL} select {_COLUMNS} from m where placed")
def s3_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "csv")
    rows = views.images(spark, d).where("placed")
    formats.write_csv(formats.with_required_columns(rows), path)
    return formats.read_csv(spark, path)


@query("s8_ranking_round_trip", f"with {RANKINGS_SQL} select query_id, rank, ref_id, round(sim, 9) as sim from r")
def s8_ranking_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "lists")
    formats.write_rankings(views.rankings(spark, d), path)
    return formats.read_rankings(spark, path).withColumn("sim", F.round("sim", 9))


@query("s11_json_records", f"with {IMAGES_SQL} select image_id, sequence_id, lat from m")
def s11_json_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as strict JSON strings and parsed again."""
    lines = formats.as_json(views.images(spark, d).select("image_id", "sequence_id", "lat"))
    return lines.select(F.inline(F.array(F.from_json("json", "image_id bigint, sequence_id string, lat double"))))


@query("s12_json_scan", f"with {IMAGES_SQL} select split, count(*) as n from m where split is not null group by 1")
def s12_json_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records with the field ``split`` among JSON files of several kinds."""
    path = folder(spark, "json")
    counts = views.images(spark, d, "split").groupBy("split").agg(F.count("*").alias("n"))
    counts.write.option("maxRecordsPerFile", 1).json(path)  # one document per file
    spark.range(3).select(F.col("id").alias("other")).write.option("maxRecordsPerFile", 1).mode("append").json(path)
    return formats.read_records(spark, path, "split", "split string, n bigint")


@query(
    "s14_tile_flatten",
    f"""with {IMAGES_SQL} select floor((lon + 180.0) / 360.0 * 16384)::bigint || '_' || floor((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 16384)::bigint as tile, {_COLUMNS}
from m where placed and abs(lat) < 85""",
)
def s14_tile_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Points grouped into tile checkpoints (a slice per tile and hash, so none is unbounded) and flattened again."""
    rows = formats.with_required_columns(views.images(spark, d).where("placed and abs(lat) < 85"))
    tile = F.concat_ws("_", tile_x("lon", 14).cast("string"), tile_y("lat", 14).cast("string"))
    part = F.pmod(F.xxhash64("image_id"), F.lit(64))
    grouped = rows.groupBy(tile.alias("tile"), part.alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("points"))
    return formats.tile_points(grouped.select(F.to_json(F.create_map("tile", "points")).alias("value")))


@query("s22_first_mentions", "select query_id, min(epoch_ms(run_at)) as first_ms from retrieval where query_id is not null group by 1")
def s22_first_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieval").select("query_id", F.unix_millis("run_at").alias("first_ms"))
    return formats.ordered_distinct(rows, "query_id", "first_ms")


@query(
    "record_merge",
    f"""with {IMAGES_SQL}, a as (select image_id, creator_id, split from m where image_id % 3 <> 0), b as (select image_id, case when image_id % 5 = 0 then null else creator_id + 1 end as creator_id, is_pano from m where image_id % 2 = 0)
select coalesce(b.image_id, a.image_id) as image_id, coalesce(b.creator_id, a.creator_id) as creator_id, a.split, b.is_pano from a full join b on a.image_id = b.image_id""",
)
def record_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = stage(views.images(spark, d, "creator_id", "split", "is_pano"), "images")
    old = rows.where("image_id % 3 <> 0").select("image_id", "creator_id", "split")
    new = rows.where("image_id % 2 = 0").select("image_id", F.when(F.col("image_id") % 5 != 0, F.col("creator_id") + 1).alias("creator_id"), "is_pano")
    return formats.merged_records(old, new, "image_id")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """Counts per class derived from the ids, for there is no table of detections."""
    i = F.col("image_id")
    counts = F.create_map(F.lit("car"), (i % 7).cast("int"), F.lit("tree"), (i % 5).cast("int"), F.lit("sky--haze"), (i % 3).cast("int"))
    return table(spark, d, "metadata").select("image_id").distinct().withColumn("counts", counts)


_DETECTIONS_SQL = """x as (select distinct image_id from metadata), d as (
  select image_id, 'car' as class, (image_id % 7)::int as n from x union all select image_id, 'tree', (image_id % 5)::int from x union all select image_id, 'sky--haze', (image_id % 3)::int from x)"""


@query("a32_detection_census", f"with {_DETECTIONS_SQL} select class, count(*) as n_images, sum(n)::bigint as n_total, median(n) as median_n from d where n > 0 group by 1")
def a32_detection_census(spark: SparkSession, d: str) -> DataFrame:
    rows = _detections(spark, d).select("image_id", F.explode("counts").alias("class", "n")).where("n > 0")
    return rows.groupBy("class").agg(F.count("*").alias("n_images"), F.sum("n").alias("n_total"), F.percentile("n", F.lit(0.5)).alias("median_n"))


@query("s13_detection_lines", f"with {_DETECTIONS_SQL} select image_id, max(n) filter (where class = 'car') as cars, max(n) filter (where class = 'tree') as trees from d group by 1")
def s13_detection_lines(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "detections")
    formats.append_detections(_detections(spark, d), path)
    return formats.read_detections(spark, path).select("image_id", F.col("counts")["car"].alias("cars"), F.col("counts")["tree"].alias("trees"))


@query(
    "v10_histogram_vectors",
    f"""with {_DETECTIONS_SQL}, k as (select * from d where n > 0 and class not like 'sky%'), f as (select class, count(*) as df from k group by 1),
w as (select k.image_id, k.class, sqrt(n) * (ln((select count(*) from x)::double / df) + 1) as w from k join f using (class))
select image_id, class, round(w / sqrt(sum(w * w) over (partition by image_id)), 6) as weight from w""",
)
def v10_histogram_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rerank.histogram_vectors(_detections(spark, d), skip_prefix="sky"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """District outlines taken as roads, for there is no table of streets; the class follows from the id."""
    kind = F.when(F.col("district_id") % 3 == 0, "primary").when(F.col("district_id") % 3 == 1, "residential").otherwise("service")
    return table(spark, d, "districts").where("rings is not null").select(F.col("district_id").alias("edge_id"), kind.alias("highway"), F.filter(F.col("rings")[0], lambda p: p.isNotNull()).alias("pts"))


_EDGES_SQL = """edges as (select district_id as edge_id, case district_id % 3 when 0 then 'primary' when 1 then 'residential' else 'service' end as highway, list_filter(rings[1], lambda p: p is not null) as pts from districts where rings is not null),
pieces as (select edge_id, highway, e[1].lon as lon1, e[1].lat as lat1, e[2].lon as lon2, e[2].lat as lat2 from (select edge_id, highway, unnest(list_zip(pts[:-2], pts[2:])) as e from edges where len(pts) >= 2)),
seg as (select row_number() over () as segment_id, *, """ + metres_sql("lat1", "lon1", "lat2", "lon2") + """ as length_m from pieces)"""


def _nearest_edge_sql(points: str) -> str:
    """CTE ``near``: the nearest edge within 100 m of each of ``points``."""
    turned = lambda v: f"((({v} - p.lon + 180) % 360 + 360) % 360 - 180)"
    x = lambda v: f"radians({turned(v)}) * cos(radians(p.lat)) * 6371000.0"
    y = lambda v: f"radians({v} - p.lat) * 6371000.0"
    return f"""{_EDGES_SQL}, p as ({points}),
ec as (select p.image_id, edge_id, highway, {x("lon1")} as x1, {y("lat1")} as y1, {x("lon2")} as x2, {y("lat2")} as y2 from p join seg on p.lat between least(lat1, lat2) - 0.001 and greatest(lat1, lat2) + 0.001),
ed as (select *, least(greatest(coalesce(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 0), 1) as t from ec),
ee as (select image_id, edge_id, highway, round(sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)), 6) as d_m from ed),
be as (select image_id, min({{'d': d_m, 'e': edge_id, 'h': highway}}) as b from ee where d_m <= 100 group by 1),
near as (select p.image_id, be.b.e as edge_id, be.b.h as highway, be.b.d as d_m from p left join be using (image_id))"""


@query("j9_nearest_edge", f"with {IMAGES_SQL}, {_nearest_edge_sql('select image_id, lat, lon from m where placed')} select image_id, edge_id, highway, round(d_m, 3) as d_m from near")
def j9_nearest_edge(spark: SparkSession, d: str) -> DataFrame:
    points = stage(views.images(spark, d, "lat", "lon").where("placed"), "points")
    return rounded(roads.nearest_edge(points, _edges(spark, d), 100.0, 100.0), 3)


@query(
    "a16_road_classes",
    f"""with {hits_sql("'database', 'train'")}, {_nearest_edge_sql("select image_id, lat, lon from q")},
f as (select coalesce(near.highway, 'none') as highway, h.d_m as error_m from h join near on near.image_id = h.query_id where rank = 1)
select highway, count(*) as n, round(count(*) / (select count(*) from f), 6) as share, round(avg((error_m <= 25)::int), 6) as recall, round(median(error_m) filter (where error_m > 25), 6) as median_wrong_m,
  round(count(*) filter (where error_m > 1000) / nullif((select count(*) from f where error_m > 1000), 0), 6) as far_share from f group by 1""",
)
def a16_road_classes(spark: SparkSession, d: str) -> DataFrame:
    s = Scene(spark, d, FULL)
    near = roads.nearest_edge(s.queries.select("image_id", "lat", "lon"), _edges(spark, d), 100.0, 100.0)
    first = s.hits.where("rank = 1").select(F.col("query_id").alias("image_id"), F.col("d_m").alias("error_m"))
    return rounded(roads.road_class_table(first.join(near, "image_id")))


@query(
    "a26_street_coverage",
    f"""with {IMAGES_SQL}, {_EDGES_SQL}, n as (select *, greatest(ceil(length_m / 25), 1)::bigint as n from seg), i as (select *, unnest(range(0, n + 1)) as i from n),
s as (select segment_id, i, lat1 + (lat2 - lat1) * i / n as lat, lon1 + (lon2 - lon1) * i / n as lon from i),
im as (select lat, lon from m where placed),
seen as (select distinct segment_id, i from s join im on im.lat between s.lat - 0.00023 and s.lat + 0.00023 where {metres_sql("s.lat", "s.lon", "im.lat", "im.lon")} <= 25),
k as (select segment_id, count(*) as hit from seen group by 1),
c as (select highway, length_m, coalesce(hit, 0)::double / (n + 1) as covered from n left join k using (segment_id))
select highway, round(sum(length_m), 2) as length_m, round(sum(length_m * covered) / sum(length_m), 9) as covered_share from c group by 1""",
)
def a26_street_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Samples no further apart than the radius, so every point of a street is near one."""
    rows = roads.street_coverage(_edges(spark, d), views.images(spark, d, "lat", "lon"), 25.0, 25.0)
    return rows.select("highway", F.round("length_m", 2).alias("length_m"), F.round("covered_share", 9).alias("covered_share"))


_LOOKS_SQL = """looks as (select n.query_id, n.ref_id, n.d_m, radians(b.lon - q.lon) * cos(radians(q.lat)) * 6371000.0 as dx, radians(b.lat - q.lat) * 6371000.0 as dy, q.heading from n join q on q.image_id = n.query_id join b on b.image_id = n.ref_id),
facing as (select query_id, ref_id, d_m from looks where sqrt(dx * dx + dy * dy) >= 15 and abs(((degrees(atan2(dx, dy)) - heading + 180) % 360 + 360) % 360 - 180) <= 25)"""


@query("g8_facing", f"with {hits_sql()}, {near_sql(100)}, {_LOOKS_SQL} select query_id, ref_id, round(d_m, 3) as d_m from facing")
def g8_facing(spark: SparkSession, d: str) -> DataFrame:
    """Query-reference pairs within 100 m where the query camera looks at the reference."""
    s = Scene(spark, d)
    near = s.near(100.0).join(s.queries.select(F.col("image_id").alias("query_id"), "lat", "lon"), "query_id").join(s.references.select(F.col("image_id").alias("ref_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), "ref_id")
    dx, dy = local_xy("r_lat", "r_lon", "lat", "lon")
    return near.where(roads.faces("q_heading", dx, dy)).select("query_id", "ref_id", F.round("d_m", 3).alias("d_m"))


@query(
    "stream_event_counts",
    "select epoch_ms(date_trunc('hour', ts)) as start_ms, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
)
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the events table read as a stream."""
    counts = arrivals.windowed_counts(arrivals.event_stream(spark, d), "event_type")
    rows = arrivals.run_available(counts, folder(spark, "stream"))
    return rows.select(F.unix_millis("start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "event_gaps",
    """with g as (select user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) as gap from events)
select user_id, count(*) as n_events, max(gap) as max_gap_ms from g group by 1""",
)
def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Longest pause of each user: the frames of problem 3 over events, so a busy user is no hot task."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("image_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("captured_at"))
    gaps = skew.frames(rows.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}))
    return gaps.groupBy(F.col("sequence_id").alias("user_id")).agg(F.count("*").alias("n_events"), F.max("gap_ms").alias("max_gap_ms"))


@query("variant_random_hits")
def variant_random_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of two variants side by side by query (J14): stored and random first hits."""
    s = Scene(spark, d)
    drawn = evaluation.hits(evaluation.random_rankings(s.queries, s.references, 1), s.queries, s.references)
    a = s.hits.where("rank = 1").select("query_id", F.col("d_m").alias("stored_m"))
    return a.join(drawn.where("rank = 1").select("query_id", F.col("d_m").alias("random_m")), "query_id")


@query(
    "w7_largest_district",
    "select district_id, district_name, area_km2 from districts where area_km2 >= 1 qualify row_number() over (partition by district_name order by area_km2 desc, district_id) = 1",
)
def w7_largest_district(spark: SparkSession, d: str) -> DataFrame:
    return examples.district_choice(table(spark, d, "districts"), 1.0)


@query(
    "j10_scenes",
    f"with {hits_sql()}, {near_sql(80)}, {_LOOKS_SQL}, o as (select query_id, min({{'d': d_m, 'r': ref_id}}) as b from facing group by 1) select query_id as image_id, b.r as target_id, round(b.d, 3) as d_m from o",
)
def j10_scenes(spark: SparkSession, d: str) -> DataFrame:
    """For each query the nearest database image its camera looks at within 80 m."""
    s = Scene(spark, d)
    return rounded(examples.scenes(s.queries.select("image_id", "lat", "lon", "heading"), s.references.select("image_id", "lat", "lon")), 3)


@query("l10_diverse_examples")
def l10_diverse_examples(spark: SparkSession, d: str) -> DataFrame:
    """Twelve first hits within 25 m from as many creators and sequences as can be."""
    good = Scene(spark, d, FULL).hits.where("rank = 1 and d_m <= 25").select("query_id", "q_creator", "q_sequence", "d_m")
    picked = examples.diverse_examples(good, 12, ("q_creator", "q_sequence"), "query_id")
    return spark.createDataFrame([tuple(r.values()) for r in picked], good.schema)


@query("embed_fake")
def embed_fake(spark: SparkSession, d: str) -> DataFrame:
    """The encoder interface with a hash encoder over the images' ids."""
    content = table(spark, d, "metadata").select("image_id").distinct().select("image_id", F.encode(F.col("image_id").cast("string"), "utf-8").alias("content"))
    return embedding.embed_images(content, embedding.HashEmbedder).select("image_id", F.size("vec").alias("dim"), "error")
