"""Problem 1: records of an evaluation split that also stand, exactly or almost, in train.

Exact prefix-filter join of token sets. Tokens are ordered from rare to frequent; two
sets that overlap enough must share a token among the first few of each, so only those
prefixes are indexed (evaluation side) and probed (training side). Length and position
filters drop hopeless candidates, and the overlap of the rest is verified.

Images become sets of time shingles: the creator with the second before, of and after
the capture. Captures at most a second apart share two of three shingles at least, so
the join loses none of them; a check on milliseconds and headings follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.sources.staging import stage

#: Counters of the token frequency sketch, which bounds what is sent to every task.
SKETCH_BINS = 1 << 16


def _bin(token: Column) -> Column:
    return F.pmod(token, F.lit(SKETCH_BINS))


def _rarity(tokens: DataFrame) -> bytes:
    """A byte for each bin of the sketch: eight times the binary logarithm of its token count.

    At most ``SKETCH_BINS`` rows reach the driver, whatever the size of the data.
    """
    rarity = np.zeros(SKETCH_BINS, dtype=np.uint8)
    for row in tokens.select(F.explode("tokens").alias("t")).groupBy(_bin(F.col("t")).alias("bin")).count().collect():
        rarity[row["bin"]] = min(255, int(8 * np.log2(1 + row["count"])))
    return rarity.tobytes()


def _rare_first(tokens: Column, rarity: bytes) -> Column:
    keyed = F.transform(F.array_distinct(tokens), lambda t: F.struct(F.substr(F.lit(rarity), (_bin(t) + 1).cast("int"), F.lit(1)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def overlap_join(evaluation: DataFrame, training: DataFrame, threshold: float) -> DataFrame:
    """All pairs of an evaluation and a training set with Jaccard similarity >= ``threshold``.

    Both frames have ``id``, ``tokens array<bigint>`` and any payload columns, which come
    out with the suffixes ``_e`` and ``_t``. Null and empty sets pair with nothing and
    repeated tokens count once. A pair comes once per shared prefix token that passes the
    filters, so callers that need pairs once apply ``distinct`` to the few that remain.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    both = evaluation.select("tokens").unionByName(training.select("tokens"))
    rarity = _rarity(both)

    def prefixes(df: DataFrame, mark: str) -> DataFrame:
        others = df.columns
        df = df.withColumn("tokens", _rare_first(F.col("tokens"), rarity)).withColumn("_n", F.size("tokens"))
        keep = F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9).cast("int") + 1
        df = df.where("_n > 0").select(*others, "_n", F.posexplode(F.slice("tokens", 1, keep)).alias("_at", "token"))
        return df.withColumnsRenamed({c: f"{c}_{mark}" for c in [*others, "_n", "_at"]})

    e, t = prefixes(evaluation, "e"), prefixes(training, "t")
    needed = F.ceil((F.col("_n_e") + F.col("_n_t")) * (threshold / (1 + threshold)) - 1e-9)
    fits = (F.col("_n_e") >= F.col("_n_t") * threshold - 1e-9) & (F.col("_n_t") >= F.col("_n_e") * threshold - 1e-9)
    reach = 1 + F.least(F.col("_n_e") - F.col("_at_e"), F.col("_n_t") - F.col("_at_t")) - 1 >= needed
    verified = F.size(F.array_intersect("tokens_e", "tokens_t")) >= needed
    return e.join(t, "token").where(fits & reach & verified).drop("_n_e", "_n_t", "_at_e", "_at_t", "token")


def heading(angle: Column) -> Column:
    """Heading in [0, 360); null for null, negative and NaN."""
    return F.when((angle >= 0) & ~F.isnan(angle), F.pmod(angle, F.lit(360.0)))


def _shingles(creator: Column, millis: Column, window_ms: int) -> Column:
    second = F.floor(millis / F.lit(window_ms))
    return F.array(*[F.xxhash64(creator, second + i) for i in (-1, 0, 1)])


def split_overlaps(images: DataFrame, window_ms: int = 1000, max_heading: float = 30.0) -> DataFrame:
    """Pairs of a train image and a query or database image that show the same moment.

    ``images`` has one row per image with ``image_id, creator_id, captured_at,
    compass_angle, split`` (cleaned). Returns ``train_id, eval_id, split, creator_id``.
    Images without creator or capture time (null, 0) or of no split are in no pair; an
    unknown heading agrees with any. A tie to the millisecond is a pair like any other.
    """
    usable = images.where("creator_id is not null and captured_at is not null and captured_at <> 0 and split in ('train', 'query', 'database')")
    facts = stage(usable.select(F.col("image_id").alias("id"), "creator_id", "captured_at", heading(F.col("compass_angle")).alias("heading"), "split"), "moments")
    sets = facts.withColumn("tokens", _shingles(F.col("creator_id"), F.col("captured_at"), window_ms))
    pairs = overlap_join(sets.where("split <> 'train'"), sets.where("split = 'train'").drop("split"), 0.5)
    turn = F.abs(F.col("heading_e") - F.col("heading_t"))
    near = (F.col("creator_id_e") == F.col("creator_id_t")) & (F.abs(F.col("captured_at_e") - F.col("captured_at_t")) <= window_ms)
    agree = F.coalesce(F.least(turn, 360.0 - turn) <= max_heading, F.lit(True))
    return pairs.where(near & agree).select(F.col("id_t").alias("train_id"), F.col("id_e").alias("eval_id"), F.col("split_e").alias("split"), F.col("creator_id_e").alias("creator_id")).distinct()


def overlap_report(images: DataFrame, window_ms: int = 1000, max_heading: float = 30.0) -> DataFrame:
    """Overlaps per evaluation split and creator: pairs, evaluation images, training images."""
    return split_overlaps(images, window_ms, max_heading).groupBy("split", "creator_id").agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval"), F.countDistinct("train_id").alias("n_train"))
