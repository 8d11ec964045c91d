"""Queries over the training-data operators and the SQL they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import cross_split, group_split, leakage, packing, shared_spans, stable_sample, vector_neighbours
from waymark.sources.staging import folder, stage
from waymark.sources.tables import metadata, table, trimmed

#: Shares of images for train, database and query.
PROPORTIONS = {"train": 0.6, "database": 0.2, "query": 0.2}

#: The newest metadata row of each image with cleaned columns, in DuckDB.
IMAGES_SQL = r"""m as (
  select image_id, trim(sequence_id, E' \t\n\r\x0b\x0c') as sequence_id, captured_at, lat, lon, compass_angle,
         creator_id, nullif(lower(trim(split, E' \t\n\r\x0b\x0c')), '') as split
  from (select *, row_number() over (partition by image_id order by ingested_at desc) as rn from metadata) where rn = 1)"""


def _moments(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d, "creator_id", "captured_at", "compass_angle", "split")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split.split_overlaps(_moments(spark, d))
    return pairs.select(F.least("train_id", "eval_id").alias("image_id_a"), F.greatest("train_id", "eval_id").alias("image_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_report(_moments(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return group_split.torn_groups(metadata(spark, d, "sequence_id", "split"), "sequence_id")


def p2_assign(spark: SparkSession, d: str) -> DataFrame:
    return group_split.assign_splits(metadata(spark, d, "sequence_id"), ["sequence_id"], PROPORTIONS).select("sequence_id", "n", "split")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return group_split.split_shares(p2_assign(spark, d), PROPORTIONS).withColumn("share", F.round("share", 9))


def p2_linked(spark: SparkSession, d: str) -> DataFrame:
    """Sequences that deliveries of one image tie together stay together, too."""
    rows = stage(table(spark, d, "metadata").select(trimmed("sequence_id").alias("sequence_id"), "image_id").where("sequence_id is not null").distinct(), "deliveries")
    moved = rows.groupBy("image_id").agg(F.min("sequence_id").alias("low"), F.max("sequence_id").alias("high")).where("low < high").select("image_id", F.col("image_id").alias("moved"))
    assigned = group_split.assign_splits(rows.join(moved, "image_id", "left"), ["sequence_id", "moved"], PROPORTIONS, seed=0)
    return assigned.groupBy("sequence_id", "component", "split").agg(F.sum("n").alias("n"))


def _persisted(spark: SparkSession, rows: DataFrame, key: str, **rates) -> DataFrame:
    """The sample through the persisted state: one delivery for the older half of the months, one for the rest."""
    state = stable_sample.SampleState(spark, folder(spark, "sample"), **rates)
    rows = stage(rows.groupBy(key).agg(F.min("ingested_at").alias("ingested_at")), "arrivals")
    middle = rows.agg(F.min(F.unix_seconds("ingested_at")), F.max(F.unix_seconds("ingested_at"))).first()
    if middle[0] is not None:
        early = F.unix_seconds("ingested_at") <= (middle[0] + middle[1]) // 2
        state.advance(rows.where(early), key)
        return state.advance(rows.where(~early), key)
    return state.advance(rows, key)


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _persisted(spark, table(spark, d, "metadata").select("image_id", "ingested_at"), "image_id")


def p4_drives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metadata").select(trimmed("sequence_id").alias("sequence_id"), "ingested_at")
    return _persisted(spark, rows, "sequence_id", target=2_000, base_rate=0.1)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_neighbours.neighbour_pairs(vector_neighbours.nearest(table(spark, d, "descriptors"), 5))


def p6_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = vector_neighbours.nearest(table(spark, d, "descriptors"), 10)
    return lists.select(F.col("image_id").alias("query_id"), "indices", F.col("similarities").cast("array<float>").alias("similarities"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the sequences are at several lengths; texts are tokenised once."""
    counted = stage(packing.token_counts(table(spark, d, "documents")), "tokens")
    reports = [packing.fill_report(packing.pack_counted(counted, c), c).select(F.lit(c).alias("capacity"), "*") for c in (1024, 2048, 4096, 8192, 32_768)]
    return reduce(DataFrame.unionByName, reports)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_shares(table(spark, d, "documents"))


def _rendezvous_sql(component: str, seed: str) -> str:
    u = lambda s: f"(('0x' || substr(md5({component} || '|{s}|' || {seed}), 1, 13))::bigint::double + 0.5) / 4503599627370496.0"
    scores = ", ".join(f"{{'score': {w / sum(PROPORTIONS.values())} / -ln({u(s)}), 'name': '{s}'}}" for s, w in sorted(PROPORTIONS.items()))
    return f"list_max([{scores}]).name"


def _threefry_sql(k0: str, k1: str, source: str, keep: str) -> str:
    """Nested queries over ``source`` that add ``x0, x1`` of Threefry-2x32 with a zero counter."""
    m = stable_sample._MASK
    words = ["k0", "k1", f"xor(xor(k0, k1), {stable_sample.PARITY})"]
    sql = f"select *, k0 as x0, k1 as x1 from (select {keep}, {k0} as k0, {k1} as k1 from {source})"
    for r in range(20):
        by = stable_sample.ROTATIONS[r % 8]
        sql = f"select {keep}, k0, k1, (x0 + x1) & {m} as x0, x1 from ({sql})"
        sql = f"select {keep}, k0, k1, x0, xor(((x1 << {by}) | (x1 >> {32 - by})) & {m}, x0) as x1 from ({sql})"
        if r % 4 == 3:
            i = (r + 1) // 4
            sql = f"select {keep}, k0, k1, (x0 + {words[i % 3]}) & {m} as x0, (x1 + {words[(i + 1) % 3]} + {i}) & {m} as x1 from ({sql})"
    return sql


def _sample_sql(key: str, rows: str, number: str, target: int, rate: float) -> str:
    return f"""with rows as ({rows}), seen as (select {key}, strftime(min(ingested_at), '%Y-%m') as epoch from rows where {key} is not null and ingested_at is not null group by 1),
n as (select epoch, count(*) as n from seen group by 1),
b as (select epoch, coalesce(sum(n) over (order by epoch rows between unbounded preceding and 1 preceding), 0) as before from n),
rates as (select epoch, case when before = 0 then {rate}::double else least({rate}::double, {target}::double / before) end as rate from b),
numbered as (select {key}, epoch, {number} as number from seen),
random as ({_threefry_sql(f"number & {stable_sample._MASK}", "number >> 32", "numbered", f"{key}, epoch")})
select {key}, epoch, rate, (x0 * 2097152.0::double + (x1 >> 11)) / 9007199254740992.0::double as u from random join rates using (epoch) where (x0 * 2097152.0::double + (x1 >> 11)) / 9007199254740992.0::double < rate"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    overlaps = f"""with {IMAGES_SQL},
h as (select image_id, creator_id, captured_at, split, case when compass_angle >= 0 then compass_angle % 360 end as a
      from m where creator_id is not null and captured_at <> 0),
pairs as (
  select t.image_id as t, e.image_id as e, e.split, e.creator_id
  from h t join h e on t.creator_id = e.creator_id and e.captured_at between t.captured_at - 1000 and t.captured_at + 1000
  where t.split = 'train' and e.split in ('query', 'database')
    and coalesce(least(abs(t.a - e.a), 360 - abs(t.a - e.a)) <= 30, true))
"""
    assigned = f"""with {IMAGES_SQL}, g as (select sequence_id, count(*) as n from m where sequence_id is not null group by 1),
t as (select sequence_id, n, seed, {_rendezvous_sql("'0:' || sequence_id", "seed")} as split from g, range(128) as r(seed)),
c as (select seed, split, sum(n) as n from t group by 1, 2),
w as (select unnest([{", ".join(f"'{s}'" for s in PROPORTIONS)}]) as split, unnest([{", ".join(str(float(w)) for w in PROPORTIONS.values())}]) as wanted),
e as (select r.seed, round(sum(abs(coalesce(c.n, 0) - wanted * (select sum(n) from g))), 6) as off from range(128) as r(seed) cross join w left join c on c.seed = r.seed and c.split = w.split group by 1),
a as (select sequence_id, n, split from t where seed = (select seed from e order by off, seed limit 1))
"""
    shared = """with w as (select doc_id, unnest(range(0, length(text) - 119)) as start, text from documents where length(text) >= 120),
s as (select doc_id, start, substr(text, start + 1, 120) as s from w),
two as (select s from s group by s having count(distinct doc_id) > 1),
c as (select doc_id, start from s semi join two using (s)),
o as (select *, coalesce((start > lag(start) over (partition by doc_id order by start) + 120)::int, 0) as opens from c),
r as (select *, sum(opens) over (partition by doc_id order by start) as run from o),
spans as (select doc_id, min(start) as span_start, max(start) + 120 as span_end from r group by doc_id, run)
"""
    return {
        "p4_sample": _sample_sql("image_id", "select image_id, ingested_at from metadata", "image_id", 20_000, 0.05),
        "p4_drives": _sample_sql("sequence_id", r"select trim(sequence_id, E' \t\n\r\x0b\x0c') as sequence_id, ingested_at from metadata", "('0x' || substr(md5(sequence_id), 1, 15))::bigint", 2_000, 0.1),
        "p9_found": shared + "select * from spans",
        "p9_shares": shared
        + """, t as (select doc_id, sum(span_end - span_start)::bigint as shared, count(*) as n from spans group by 1)
select d.doc_id, coalesce(length(text), 0) as n_chars, coalesce(shared, 0) as shared_chars, coalesce(n, 0) as n_spans,
  case when length(text) > 0 then coalesce(shared, 0)::double / length(text) else 0.0 end as shared_share from documents d left join t using (doc_id)""",
        "p2_assign": assigned + "select sequence_id, n, split from a",
        "p2_shares": assigned + "select w.split, coalesce(sum(a.n), 0)::bigint as n, round(coalesce(sum(a.n), 0) / (select sum(n) from a), 9) as share, wanted from w left join a using (split) group by w.split, wanted",
        "p2_linked": rf"""with recursive d as (select distinct trim(sequence_id, E' \t\n\r\x0b\x0c') as s, image_id from metadata where sequence_id is not null),
moved as (select image_id from d group by 1 having count(*) > 1),
n as (select s, count(*) as n from d group by 1),
l as (select distinct a.s as a, b.s as b from d a join d b using (image_id) where image_id in (select image_id from moved)),
r as (select s, s as least from n union select r.s, l.b from r join l on l.a = r.least),
c as (select s, '0:' || min(least) as component from r group by 1)
select s as sequence_id, component, {_rendezvous_sql("component", "'0'")} as split, n from c join n using (s)""",
        "p1_found": overlaps + "select least(t, e) as image_id_a, greatest(t, e) as image_id_b from pairs",
        "p1_report": overlaps + "select split, creator_id, count(*) as n_pairs, count(distinct e) as n_eval, count(distinct t) as n_train from pairs group by all",
        "p2_found": f"with {IMAGES_SQL} select sequence_id from m where sequence_id is not null group by 1 having count(distinct split) > 1",
    }
