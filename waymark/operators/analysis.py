"""Analyses of result lists: difficulty, origin, confusion, errors, rejection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import haversine, heading_difference, heading_matches
from waymark.operators.evaluation import DAY_MS
from waymark.operators.quantiles import exact_quantiles
from waymark.operators.skew import cut
from waymark.sources.staging import stage


def difficulty(queries: DataFrame, near: DataFrame, max_degrees: float = 90.0) -> DataFrame:
    """Per query neighbours, whole days to the nearest in time, heading ok, same creator within a day.

    Queries without a neighbour keep their row with 0 and nulls.
    """
    days = F.abs(F.col("q_at") - F.col("r_at")) / DAY_MS
    per = near.groupBy("query_id").agg(
        F.count("*").alias("n_near"), F.floor(F.min(days)).alias("min_days"), F.bool_or(heading_matches("q_heading", "r_heading", max_degrees)).alias("heading_ok"),
        F.coalesce(F.bool_or((F.col("q_creator") == F.col("r_creator")) & (days < 1)), F.lit(False)).alias("same_day"),
    )
    ids = queries.select(F.col("image_id").alias("query_id"))
    return ids.join(per, "query_id", "left").select("query_id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "min_days", F.coalesce("heading_ok", F.lit(False)).alias("heading_ok"), F.coalesce("same_day", F.lit(False)).alias("same_day"))


def binned(value: Column, classes: Sequence[tuple[str, int, int | None]]) -> Column:
    """Name of the closed integer range that holds ``value``; null outside all of them."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(classes):
        out = F.when((value >= low) if high is None else value.between(low, high), F.lit(name)).otherwise(out)
    return out


def recall_by_class(flags: DataFrame, classes: Sequence[tuple[str, int, int | None]], value: Column, hit: Column) -> DataFrame:
    """A10: queries and R@1 per class; classes without queries keep a row with 0 and null."""
    names = flags.sparkSession.createDataFrame([(n,) for n, _, _ in classes], "class string")
    per = flags.groupBy(binned(value, classes).alias("class")).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("recall"))
    return names.join(per, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "recall")


def top1_origin(found: DataFrame, threshold_m: float = 25.0) -> DataFrame:
    """Where correct first hits come from."""
    days = F.abs(F.col("q_at") - F.col("r_at")) / DAY_MS
    same = F.col("q_creator") == F.col("r_creator")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    rows = stage(found.where((F.col("rank") == 1) & (F.col("d_m") <= threshold_m)).select(days.alias("days"), same.alias("same"), heading_difference("q_heading", "r_heading").alias("turn")), "origin")
    days, same = F.col("days"), F.col("same")
    out = rows.agg(
        F.count("*").alias("n"), share(same).alias("same_creator_share"), share(same & (days <= 180)).alias("duplicate_share"),
        share(days < 1).alias("within_day_share"), share(days > 365).alias("over_year_share"),
    )
    medians = [F.lit(exact_quantiles(rows, c, [0.5])[0]).cast("double").alias(f"median_{c}") for c in ("days", "turn")]
    return out.select("n", "same_creator_share", "duplicate_share", medians[0], "within_day_share", "over_year_share", medians[1])


def confusion_pairs(first: DataFrame, top: int = 20) -> DataFrame:
    """Regions mistaken for each other: ``q_region, r_region, n, median_m`` and share of all errors.

    ``first`` has one row per wrong first hit with both regions and ``d_m``.
    """
    total = first.agg(F.count("*")).scalar()
    pairs = first.where("q_region <> r_region").groupBy("q_region", "r_region").agg(F.count("*").alias("n"), F.percentile("d_m", F.lit(0.5)).alias("median_m"))
    return pairs.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "q_region", "r_region").limit(top)


def error_quantiles(first: DataFrame) -> DataFrame:
    """Quartiles and 90 % quantile of the error, shares below 100 m, to 1 km, and beyond."""
    share = lambda c: F.avg(c.cast("double"))
    d = F.col("d_m")
    rows = first.agg(F.count("*").alias("n"), share(d < 100).alias("below_100"), share((d >= 100) & (d < 1000)).alias("to_1000"), share(d >= 1000).alias("beyond_1000"))
    return rows.select("n", *_quartiles(first, "d_m"), "below_100", "to_1000", "beyond_1000")


def _quartiles(df: DataFrame, value: str) -> list[Column]:
    found = exact_quantiles(df, value, (0.25, 0.5, 0.75, 0.9))
    return [F.lit(v).cast("double").alias(n) for n, v in zip(("p25", "p50", "p75", "p90"), found)]


def localization_stats(errors: DataFrame, steps: Sequence[float] = (10, 25, 50, 100)) -> DataFrame:
    """Median, quartiles, 90 % quantile of ``error_m`` and shares within each step.

    The quantiles are exact and found by narrowing histograms, so no task holds all errors.
    """
    rows = errors.agg(F.count("*").alias("n"), *[F.avg((F.col("error_m") <= s).cast("double")).alias(f"within_{s:g}") for s in steps])
    return rows.select("n", *_quartiles(errors, "error_m"), *[f"within_{s:g}" for s in steps])


def error_cdf(errors: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Share of errors up to each edge, from one pass."""
    cells = [F.struct(F.lit(float(e)).alias("edge_m"), F.avg((F.col("error_m") <= e).cast("double")).alias("share")) for e in edges]
    return errors.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def confidences(found: DataFrame, k: int = 10, radius_m: float = 50.0) -> DataFrame:
    """Per query first similarity, margin to the second, cohesion and spread of the top ``k``.

    Cohesion is the share of the top ``k`` within ``radius_m`` of the first hit, spread the
    greatest distance to it. A list of one has no margin.
    """
    top = found.where(F.col("rank") <= k)
    first = top.where("rank = 1").select("query_id", F.col("r_lat").alias("lat1"), F.col("r_lon").alias("lon1"))
    away = haversine("lat1", "lon1", "r_lat", "r_lon")
    rows = top.join(first, "query_id").withColumn("away", away)
    sim = lambda r: F.max(F.when(F.col("rank") == r, F.col("sim")))
    return rows.groupBy("query_id").agg(
        sim(1).alias("confidence"), (sim(1) - sim(2)).alias("margin"), F.avg((F.col("away") <= radius_m).cast("double")).alias("cohesion"), F.max("away").alias("spread_m"),
    )


def rejection_curve(scored: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """Running precision by descending confidence: ``query_id, n_kept, coverage, precision``.

    ``scored`` has ``query_id, confidence, correct``. Ties are ordered by query id, unknown
    confidences (null, NaN) come last. All rows are one sequence, cut like a heavy one (see
    ``skew``): by confidence, and by query id where many share one, so no task orders more
    than about twice ``rows_per_task``; the counts of the cells before are added.
    """
    known = F.nanvl("confidence", F.lit(float("-inf")))
    rows = stage(scored.select(F.lit("all").alias("sequence_id"), F.col("query_id").alias("image_id"), F.coalesce(-known, F.lit(float("inf"))).alias("_key"), F.col("correct").cast("long").alias("good")), "scored")
    total = rows.count()
    cells = cut(rows, rows_per_task)
    cell = ["sequence_id", "_path"]
    along = Window.partitionBy("sequence_id").orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    sums = cells.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("good").alias("c"))
    before = sums.select(*cell, *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"{c}0") for c in ("n", "c")])
    inside = Window.partitionBy(*cell).orderBy("_key", "image_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("kept", F.count("*").over(inside)).withColumn("right", F.coalesce(F.sum("good").over(inside), F.lit(0))).join(before, cell)
    kept, right = F.col("n0") + F.col("kept"), F.col("c0") + F.col("right")
    return ranked.select(F.col("image_id").alias("query_id"), kept.alias("n_kept"), (kept / F.lit(total)).alias("coverage"), (right / kept).alias("precision"))


def precision_at_coverage(curve: DataFrame, coverages: Sequence[float] = (0.8, 0.5, 0.2)) -> DataFrame:
    """Precision at the first point with at least each coverage, and the area under the curve (trapezoid).

    The trapezoid joins a point to its follower by ``n_kept``, an equi-join rather than a global sort.
    """
    after = curve.select((F.col("n_kept") + 1).alias("n_kept"), F.col("precision").alias("p0"), F.col("coverage").alias("c0"))
    area = F.sum((F.col("precision") + F.col("p0")) / 2 * (F.col("coverage") - F.col("c0")))
    at = [F.min_by("precision", F.when(F.col("coverage") >= c, F.col("coverage"))).alias(f"precision_{round(c * 100)}") for c in coverages]
    return curve.join(after, "n_kept", "left").agg(*at, area.alias("auc"))


def pairwise_auc(candidates: DataFrame, score: str, correct: str = "correct") -> DataFrame:
    """Chance that a right candidate of a query outscores a wrong one, pooled over pairs, ties a half.

    Per query the pairs are counted from ranks, not built: with average ranks the sum over
    right candidates gives wins plus half the ties.
    """
    rows = candidates.where(F.col(score).isNotNull() & F.col(correct).isNotNull())
    w = Window.partitionBy("query_id")
    below = F.count("*").over(w.orderBy(score).rangeBetween(Window.unboundedPreceding, 0))
    same = F.count("*").over(Window.partitionBy("query_id", score))
    rows = rows.withColumn("avg_rank", below - (same - 1) / 2)
    per = rows.groupBy("query_id").agg(F.count_if(correct).alias("p"), F.count_if(~F.col(correct)).alias("n"), F.sum(F.when(F.col(correct), F.col("avg_rank"))).alias("ranks"))
    wins = F.sum(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2)
    return per.where("p > 0 and n > 0").agg(F.coalesce(F.sum(F.col("p") * F.col("n")), F.lit(0)).alias("n_pairs"), F.try_divide(wins, F.sum(F.col("p") * F.col("n"))).alias("auc"))
