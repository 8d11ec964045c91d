"""Problem 3: per-key results although a few keys hold most rows.

Heavy hitters are found by a counting sketch whose bins never understate a key, so no
heavy key is missed; the keys in heavy bins are then counted exactly. Rows of heavy keys
are cut into time ranges through a join with the keys' cut points (a broadcast while they
are few), all other rows go through the ordinary shuffle, and both are united.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import haversine, usable_position
from waymark.sources.staging import stage

#: Bins of the counting sketch.
SKETCH_BINS = 1 << 16
#: Cut points of a heavy key in one round, and rows of a table of keys or cut points that is broadcast.
CUTS, BROADCAST_ROWS = 1000, 10_000


def heavy_keys(rows: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """``<key>, n`` of the non-null keys with at least ``share`` of all rows, exactly.

    Heavy bins, ``SKETCH_BINS`` at most, are broadcast; nothing reaches the driver. A null
    key is never heavy but its rows count in the total; an empty table has no heavy keys.
    """
    part = Fraction(str(share)).limit_denominator(10**9)
    if not 0 < part <= 1:
        raise ValueError("share must lie in (0, 1]")
    bin_ = F.pmod(F.xxhash64(key), F.lit(SKETCH_BINS))
    counts = rows.groupBy(F.when(F.col(key).isNotNull(), bin_).alias("_bin")).agg(F.count("*").alias("_many"))
    heavy = counts.withColumn("_total", F.sum("_many").over(Window.partitionBy())).where("_bin is not null")  # one row a bin
    least = F.col("_total") * part.numerator
    heavy = heavy.where(F.col("_many") * part.denominator >= least).select("_bin", "_total")
    exact = rows.where(F.col(key).isNotNull()).withColumn("_bin", bin_).join(F.broadcast(heavy), "_bin").groupBy(key).agg(F.count("*").alias("n"), F.max("_total").alias("_total"))
    return exact.where(F.col("n") * part.denominator >= least).select(key, "n")


def _steps() -> list[Column]:
    gap = (F.col("_t") - F.col("_prev._t")).alias("gap_ms")
    known = usable_position("lat", "lon") & usable_position(F.col("_prev.lat"), F.col("_prev.lon"))
    step = F.when(known, haversine("_prev.lat", "_prev.lon", "lat", "lon"))
    seconds = (F.col("_t") - F.col("_prev._t")) / 1000.0
    return [F.col("_no").cast("long").alias("frame_no"), gap, step.alias("step_m"), F.when(seconds > 0, step / seconds).alias("speed_ms")]


def _small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if it has no more than ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def cut(hot: DataFrame, rows_per_task: int) -> DataFrame:
    """``hot`` with ``_path``: cells of at most about twice ``rows_per_task`` rows, in order by ``_path``.

    Every round cuts what is still too large at quantiles of its times, or of its image ids
    where all rows share one time, into a thousand ranges at most; a cut value is a range of
    its own. Rounds go on until every cell is small, so there is no largest key.
    """
    fractions = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    hot = hot.withColumn("_path", F.array().cast("array<int>"))
    while True:
        sizes = hot.groupBy("sequence_id", "_path").agg(F.count("*").alias("_n"), F.min("_key").alias("_low"), F.max("_key").alias("_high"), (F.min("image_id") < F.max("image_id")).alias("_differ"))
        # Rows that repeat one image have no order among them to cut by.
        large = stage(sizes.where((F.col("_n") > 2 * rows_per_task) & ((F.col("_low") < F.col("_high")) | F.col("_differ"))).drop("_differ"), "large")
        if not large.limit(1).count():
            return hot
        # No ranges of a key beyond what it needs.
        step = F.greatest(F.lit(1), F.floor(F.lit(CUTS) * rows_per_task / F.col("_n"))).cast("int")
        marked = hot.join(_small(large.withColumn("_step", step)), ["sequence_id", "_path"])
        value = F.when(F.col("_low") < F.col("_high"), F.col("_key")).otherwise(F.col("image_id"))
        cuts = marked.groupBy("sequence_id", "_path").agg(F.percentile_approx(value, fractions, 10 * CUTS).alias("_c"), F.first("_step").alias("_step"), F.first(F.col("_low") < F.col("_high")).alias("_by_time"))
        cuts = stage(cuts.select("sequence_id", "_path", "_by_time", F.array_distinct(F.filter("_c", lambda c, i: i % F.col("_step") == F.col("_step") - 1)).alias("_cuts")), "cuts")
        at = F.when(F.col("_by_time"), F.col("_key")).otherwise(F.col("image_id"))
        place = 2 * F.size(F.filter("_cuts", lambda c: c < at)) + F.array_contains("_cuts", at).cast("int")
        hot = hot.join(_small(cuts), ["sequence_id", "_path"], "left").withColumn("_path", F.when(F.col("_cuts").isNull(), F.col("_path")).otherwise(F.array_append("_path", place)))
        hot = hot.drop("_cuts", "_by_time")


def frames(images: DataFrame, share: float | None = None, rows_per_task: int = 100_000) -> DataFrame:
    """Order of the frames of every sequence, with time gap, distance and speed to the frame before.

    ``images`` has one row per image: ``image_id, sequence_id, captured_at, lat, lon``.
    Frames are ordered by ``captured_at, image_id``; an unknown time (null or 0) comes last
    and has no gap. Distances need two usable positions, speeds a positive gap. Images
    without a sequence have no frame order and are left out. A sequence is heavy from
    ``share`` of all rows, by default from ten times ``rows_per_task``; a task orders at most
    about twice ``rows_per_task`` rows of a heavy one, whatever its size (see ``cut``).
    """
    base = stage(
        images.where("sequence_id is not null").select("sequence_id", "image_id", F.when(F.col("captured_at") != 0, F.col("captured_at")).alias("_t"), "lat", "lon"),
        "frames",
    )
    seat = F.struct("_t", "lat", "lon")
    order = [F.col("_t").asc_nulls_last(), F.col("image_id")]
    out = ["sequence_id", "image_id"]
    if share is None:
        share = min(0.02, max(1e-9, 10 * rows_per_task / max(base.count(), 1)))
    keys = stage(heavy_keys(base, "sequence_id", share).select("sequence_id"), "heavy")
    heavy = _small(keys)
    w = Window.partitionBy("sequence_id").orderBy(*order)
    calm = base.join(heavy, "sequence_id", "left_anti").withColumn("_no", F.row_number().over(w)).withColumn("_prev", F.lag(seat).over(w)).select(*out, *_steps())
    if not keys.limit(1).count():
        return calm

    hot = base.join(heavy, "sequence_id", "left_semi").withColumn("_key", F.coalesce("_t", F.lit((1 << 63) - 1)))
    hot = cut(hot, rows_per_task)
    cell = ["sequence_id", "_path"]
    ends = hot.groupBy(*cell).agg(F.count("*").alias("_n"), F.max(F.struct("_key", "image_id", seat.alias("seat"))).alias("_last"))
    along = Window.partitionBy("sequence_id").orderBy("_path")  # one row a cell
    carried = ends.select(*cell, F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last.seat").over(along).alias("_carried"))
    inside = Window.partitionBy(*cell).orderBy(*order)
    ranked = hot.withColumn("_no", F.row_number().over(inside)).withColumn("_prev", F.lag(seat).over(inside)).join(carried, cell)
    ranked = ranked.withColumn("_prev", F.when(F.col("_no") == 1, F.col("_carried")).otherwise(F.col("_prev"))).withColumn("_no", F.col("_no") + F.col("_before"))
    return calm.unionByName(ranked.select(*out, *_steps()))


def sequence_stats(images: DataFrame, share: float | None = None, rows_per_task: int = 100_000) -> DataFrame:
    """Per sequence: frames, gaps, mean and longest gap, metres travelled and greatest speed."""
    rows = frames(images, share, rows_per_task)
    return rows.groupBy("sequence_id").agg(
        F.count("*").alias("n_frames"), F.count("gap_ms").alias("n_gaps"), F.avg("gap_ms").alias("mean_gap_ms"), F.max("gap_ms").alias("max_gap_ms"),
        F.sum("step_m").alias("metres"), F.max("speed_ms").alias("max_speed_ms"),
    )
