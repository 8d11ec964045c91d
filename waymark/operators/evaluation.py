"""Recall@k of result lists under several definitions of a correct hit.

A ground truth is a boolean column over the attributes of the query (``q_*``) and of the
reference (``r_*``); any such column can be passed in. It filters numerator and
denominator alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import haversine, heading_matches
from waymark.operators.nearby import near_pairs

THRESHOLDS = (5.0, 10.0, 25.0, 50.0, 100.0)
KS = (1, 5, 10)
DAY_MS = 86_400_000.0
#: Attributes a ground truth may refer to, by their names in ``images``.
ATTRIBUTES = {"lat": "lat", "lon": "lon", "heading": "heading", "creator_id": "creator", "captured_at": "at", "sequence_id": "sequence", "is_pano": "pano", "compass_angle": "compass"}


def queries_of(images: DataFrame, keep: Column | None = None) -> DataFrame:
    """Placed query images."""
    rows = images.where((F.col("split") == "query") & F.col("placed"))
    return rows if keep is None else rows.where(keep)


def references_of(images: DataFrame, splits: Sequence[str] = ("database",)) -> DataFrame:
    """Placed reference images; ``('database', 'train')`` is the full reference."""
    return images.where(F.col("split").isin(list(splits)) & F.col("placed"))


def _side(images: DataFrame, key: str, mark: str) -> DataFrame:
    return images.select(F.col("image_id").alias(key), *[F.col(c).alias(f"{mark}_{short}") for c, short in ATTRIBUTES.items() if c in images.columns])


def hits(rankings: DataFrame, queries: DataFrame, references: DataFrame) -> DataFrame:
    """Result lists reduced to the given images and ranked anew, with both sides' attributes and ``d_m``.

    Catalyst broadcasts a side only if it is small; all joins are equi-joins on ids.
    """
    rows = rankings.join(_side(queries, "query_id", "q"), "query_id").join(_side(references, "ref_id", "r"), "ref_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return rows.withColumn("rank", rank).withColumn("d_m", haversine("q_lat", "q_lon", "r_lat", "r_lon"))


def nearby(queries: DataFrame, references: DataFrame, radius_m: float) -> DataFrame:
    """Query-reference pairs within ``radius_m`` with attributes ``q_*``, ``r_*``."""
    carry = tuple(c for c in ATTRIBUTES if c in queries.columns and c not in ("lat", "lon"))
    pairs = near_pairs(queries, references, radius_m, carry=carry)
    names = {"left_id": "query_id", "right_id": "ref_id"}
    for c in carry:
        names |= {f"left_{c}": f"q_{ATTRIBUTES[c]}", f"right_{c}": f"r_{ATTRIBUTES[c]}"}
    return pairs.withColumnsRenamed(names)


def any_hit() -> Column:
    """Every reference within the threshold counts."""
    return F.lit(True)


def days_apart() -> Column:
    return F.abs(F.col("q_at") - F.col("r_at")) / DAY_MS


def hard_hit(days: float = 180.0) -> Column:
    """Another creator, or more than ``days`` apart; unknown values don't make a hit."""
    return F.coalesce((F.col("q_creator") != F.col("r_creator")) | (days_apart() > days), F.lit(False))


def facing_hit(max_degrees: float = 90.0) -> Column:
    """T4: headings agree within ``max_degrees`` or one is unknown."""
    return heading_matches("q_heading", "r_heading", max_degrees)


def twin(window_ms: int = 60_000) -> Column:
    """Same known creator and captures at most ``window_ms`` apart (inclusive)."""
    return F.coalesce((F.col("q_creator") == F.col("r_creator")) & (F.abs(F.col("q_at") - F.col("r_at")) <= window_ms), F.lit(False))


def not_twin(window_ms: int = 60_000) -> Column:
    """T5."""
    return ~twin(window_ms)


def solvable(near: DataFrame, truth: Column | None = None) -> DataFrame:
    """``query_id, nearest_m``: distance of the nearest correct reference."""
    rows = near if truth is None else near.where(truth)
    return rows.groupBy("query_id").agg(F.min("d_m").alias("nearest_m"))


def per_query(queries: DataFrame, near: DataFrame, found: DataFrame, truth: Column | None = None, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row per query: ``nearest_m`` and for each threshold the best rank of a correct hit."""
    truth = any_hit() if truth is None else truth
    best = found.where(truth).groupBy("query_id").agg(*[F.min(F.when(F.col("d_m") <= t, F.col("rank"))).alias(f"rank_{t:g}") for t in thresholds])
    return queries.select(F.col("image_id").alias("query_id"), "sequence_id").join(solvable(near, truth), "query_id", "left").join(best, "query_id", "left")


def recall(flags: DataFrame, thresholds: Sequence[float] = THRESHOLDS, ks: Sequence[int] = KS) -> DataFrame:
    """``threshold_m, k, n_queries, n_solvable, n_hits, recall`` in one pass over the queries.

    The denominator is the solvable queries; recall is null where there are none.
    """
    cells = []
    for t in thresholds:
        for k in ks:
            ok = F.col("nearest_m") <= t
            cells.append(F.struct(F.lit(float(t)).alias("threshold_m"), F.lit(k).alias("k"), F.count("*").alias("n_queries"), F.count_if(ok).alias("n_solvable"), F.count_if(ok & (F.col(f"rank_{t:g}") <= k)).alias("n_hits")))
    rows = flags.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return rows.withColumn("recall", F.try_divide("n_hits", "n_solvable"))


def dense_positions(rows: DataFrame, key: str, lanes: int = 1024) -> DataFrame:
    """``rows`` with ``pos`` from 0 to n - 1, without gathering them in one task.

    Rows are numbered inside ``lanes`` hash lanes; lane offsets are a table of that size.
    """
    lane = F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")
    counts = rows.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("lane", before.alias("before"))
    numbered = rows.withColumn("lane", lane).withColumn("nth", F.row_number().over(Window.partitionBy("lane").orderBy(key)))
    return numbered.join(F.broadcast(offsets), "lane").withColumn("pos", F.col("before") + F.col("nth") - 1).drop("lane", "nth", "before")


def random_rankings(queries: DataFrame, references: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """``k`` references drawn with replacement for each query by a hash of query, rank and seed."""
    placed = dense_positions(references.select(F.col("image_id").alias("ref_id")), "ref_id")
    n = references.count()
    ranks = queries.select(F.col("image_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank"))
    drawn = ranks.withColumn("pos", F.pmod(F.xxhash64("query_id", "rank", F.lit(seed)), F.lit(max(n, 1))))
    return drawn.join(placed, "pos").select("query_id", "rank", "ref_id", F.lit(None).cast("double").alias("sim"))
