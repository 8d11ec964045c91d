"""Splits of sequences, validation halves, pairs and triplet bands."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import haversine
from waymark.operators.evaluation import dense_positions
from waymark.operators.nearby import near_pairs
from waymark.sources.staging import stage

#: File names of the split lists, fixed values.
LIST_FILES = {"train": "train_sequences.txt", "database": "database_sequences.txt", "query": "query_sequences.txt"}


def draw_split(sequence_ids: list[str], seed: int, train: float, database: float) -> dict[str, list[str]]:
    """A seeded draw over sequences; query takes the rest and each split gets one at least.

    Runs on the driver, for the draw is defined by one shuffle of all ids in string order;
    for more sequences than that suits, see the group-safe split of the training operators.
    """
    ids = sorted(map(str, sequence_ids))
    n = len(ids)
    if n < 3:
        raise ValueError(f"a split needs at least 3 sequences, there are {n}")
    # The shuffle and its bounds are fixed: the same seed has to give the lists that were drawn before.
    random.Random(seed).shuffle(ids)
    first = max(1, min(max(1, round(n * train)), n - 2))
    second = max(1, round(n * database))
    second = min(second, n - first - 1)
    return {"train": ids[:first], "database": ids[first : first + second], "query": ids[first + second :]}


def read_split_lists(folder: str | Path) -> dict[str, list[str]] | None:
    """The three lists, or None if one is missing."""
    files = {s: Path(folder) / f for s, f in LIST_FILES.items()}
    if not all(f.exists() for f in files.values()):
        return None
    return {s: f.read_text(encoding="utf-8").split() for s, f in files.items()}


def require_split_lists(folder: str | Path) -> dict[str, list[str]]:
    """The three lists, or an error that names the missing files."""
    lists = read_split_lists(folder)
    if lists is None:
        missing = [f for f in LIST_FILES.values() if not (Path(folder) / f).exists()]
        raise FileNotFoundError(f"split lists missing in {folder}: {', '.join(missing)}")
    return lists


def write_split_lists(folder: str | Path, lists: dict[str, list[str]]) -> None:
    """One id per line."""
    for split, name in LIST_FILES.items():
        (Path(folder) / name).write_text("".join(f"{s}\n" for s in lists[split]), encoding="utf-8")


def adopt_split(images: DataFrame, lists: DataFrame, least: float = 0.5) -> DataFrame:
    """Images with the split of the lists; raises if less than ``least`` of the listed sequences exist."""
    listed = lists.select("sequence_id").distinct()
    known = images.select("sequence_id").distinct()
    row = listed.join(known.withColumn("there", F.lit(1)), "sequence_id", "left").agg(F.count("*").alias("n"), F.count("there").alias("k")).first()
    if row["n"] and row["k"] / row["n"] < least:
        raise ValueError(f"only {row['k']} of {row['n']} listed sequences are in the data; the lists belong to other data")
    drawn = lists.groupBy("sequence_id").agg(F.min("split").alias("split"))
    return images.drop("split").join(drawn, "sequence_id", "left")


def fit_and_validation(sequence_ids: list[str], fraction: float, seed: int) -> tuple[list[str], list[str]]:
    """Sequences for fitting and for validation, at least one for the latter."""
    ids = sorted(map(str, set(sequence_ids)))
    random.Random(seed).shuffle(ids)
    n = max(1, int(fraction * len(ids)))
    return ids[n:], ids[:n]


def validation_halves(sequences: DataFrame) -> DataFrame:
    """The first half of the sequences in string order is database, the rest query.

    A single sequence is both. ``sequences`` has ``sequence_id``; the order is found from
    counts of leading characters and a window inside each, not from one global sort.
    """
    ids = sequences.where("sequence_id is not null").select("sequence_id").distinct().withColumn("head", F.substring("sequence_id", 1, 2))
    counts = ids.groupBy("head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select("head", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("head").orderBy("sequence_id"))
    rows = ids.join(F.broadcast(heads), "head").withColumn("place", place)
    half = F.greatest(F.floor(F.col("total") / 2), F.lit(1))
    roles = F.when(F.col("total") == 1, F.array(F.lit("database"), F.lit("query"))).when(F.col("place") <= half, F.array(F.lit("database"))).otherwise(F.array(F.lit("query")))
    return rows.select("sequence_id", F.explode(roles).alias("half"))


def triplet_bands(fit: DataFrame, blocked_m: float = 25.0, hard_m: float = 100.0) -> DataFrame:
    """Per anchor the images too near to be a negative and the ring of hard negatives.

    ``fit`` has ``image_id, lat, lon``. Returns ``image_id, n_blocked, n_hard``; an image
    blocks itself, which is not counted.
    """
    pairs = near_pairs(fit, fit, hard_m).where("left_id <> right_id")
    return pairs.groupBy(F.col("left_id").alias("image_id")).agg(F.count_if(F.col("d_m") <= blocked_m).alias("n_blocked"), F.count_if(F.col("d_m") > blocked_m).alias("n_hard"))


def hard_negatives(fit: DataFrame, n: int = 1, seed: int = 0, blocked_m: float = 25.0, hard_m: float = 100.0, hard_share: float = 0.75, tries: int = 32) -> DataFrame:
    """``n`` negatives per anchor, hard ones with probability ``hard_share``, else easy ones.

    Hard negatives come from the ring, in the order of a seeded hash of both ids, again from
    its start if it has fewer than asked for. Easy ones are any image that isn't blocked, found
    by up to ``tries`` seeded throws at all of ``fit``; anchors with an empty ring have only these.
    If every throw is blocked the ring helps out, and without one there is an error.
    """
    ring = near_pairs(fit, fit, hard_m).where((F.col("d_m") > blocked_m) & (F.col("left_id") != F.col("right_id")))
    w = Window.partitionBy("left_id").orderBy(F.xxhash64("left_id", "right_id", F.lit(seed)), "right_id")
    first = ring.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).groupBy(F.col("left_id").alias("anchor_id")).agg(F.sort_array(F.collect_list(F.struct("nth", "right_id", "d_m"))).alias("ring"))
    slots = fit.select(F.col("image_id").alias("anchor_id"), "lat", "lon", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("slot")).join(first, "anchor_id", "left")
    hard = F.when(F.col("ring").isNotNull(), F.get("ring", F.pmod(F.col("slot") - 1, F.size("ring"))))
    u = F.pmod(F.xxhash64("anchor_id", "slot", F.lit(seed), F.lit("hard")), F.lit(1 << 52)) / float(1 << 52)
    slots = stage(slots.select("anchor_id", "slot", "lat", "lon", hard.alias("hard"), (F.col("ring").isNotNull() & (u < hard_share)).alias("is_hard")), "slots")
    from_ring = [F.col("anchor_id"), F.col("hard.right_id").alias("negative_id"), F.col("hard.d_m").alias("d_m")]
    rows, left = slots.where("is_hard").select(*from_ring), slots.where("not is_hard")

    places = stage(dense_positions(fit.select("image_id", "lat", "lon"), "image_id"), "places")
    size = places.count()
    # Few throws are blocked, so the second round is small.
    for low, high in ((1, min(2, tries)), (3, tries)):
        if low > high or left.isEmpty():
            continue
        thrown = left.select("anchor_id", "slot", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("nth"))
        thrown = thrown.withColumn("pos", F.pmod(F.xxhash64("anchor_id", "slot", "nth", F.lit(seed)), F.lit(size)))
        met = thrown.join(places, "pos").withColumn("d_m", haversine("a_lat", "a_lon", "lat", "lon")).where((F.col("d_m") > blocked_m) & (F.col("image_id") != F.col("anchor_id")))
        easy = stage(met.groupBy("anchor_id", "slot").agg(F.min(F.struct("nth", "image_id", "d_m")).alias("b")), "easy")
        rows = rows.unionByName(easy.select("anchor_id", F.col("b.image_id").alias("negative_id"), F.col("b.d_m").alias("d_m")))
        left = stage(left.join(easy, ["anchor_id", "slot"], "left_anti"), "left")
    bare = left.where("hard is null").select("anchor_id").first()
    if bare is not None:
        raise ValueError(f"no negative for anchor {bare[0]}: every throw is blocked and its ring is empty")
    return rows.unionByName(left.select(*from_ring))


def random_split(images: DataFrame, proportions: dict[str, float], seed: int = 0) -> DataFrame:
    """A split per image by a seeded hash, which tears sequences; for contrast only."""
    total, edge = sum(proportions.values()), 0.0
    u = (F.pmod(F.xxhash64("image_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("u")
    rows, split = images.withColumn("_u", u), F.lit(None).cast("string")
    for name, share in sorted(proportions.items(), reverse=True):
        split = F.when(F.col("_u") < 1.0 - edge, F.lit(name)).otherwise(split)
        edge += share / total
    return rows.withColumn("split", split).drop("_u")
