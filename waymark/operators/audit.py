"""Dataset audit: census, consistency, neighbourhood and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.operators.evaluation import DAY_MS
from waymark.operators.quantiles import exact_quantiles
from waymark.sources.staging import stage


def null_census(df: DataFrame) -> DataFrame:
    """``column, n_null, n_rows``: one row per column, from one pass."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count("*").alias("n_rows")) for c in df.columns]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def split_counts(images: DataFrame) -> DataFrame:
    """Images, sequences and creators per split, null split included."""
    return images.groupBy("split").agg(F.count("*").alias("n_images"), F.countDistinct("sequence_id").alias("n_sequences"), F.countDistinct("creator_id").alias("n_creators"))


def sequence_lengths(images: DataFrame) -> DataFrame:
    return images.where("sequence_id is not null").groupBy("sequence_id").agg(F.count("*").alias("n"))


def sequence_length_stats(images: DataFrame) -> DataFrame:
    """One row: sequences, single images, median, mean, shortest and longest."""
    return sequence_lengths(images).agg(
        F.count("*").alias("n_sequences"), F.count_if(F.col("n") == 1).alias("n_single"), F.percentile("n", F.lit(0.5)).alias("median_n"),
        F.avg("n").alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"),
    )


def extreme_sequences(images: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` longest and shortest sequences; ties go to the smaller id."""
    sizes = sequence_lengths(images)
    longest = sizes.orderBy(F.desc("n"), "sequence_id").limit(n).withColumn("end", F.lit("longest"))
    return longest.unionByName(sizes.orderBy("n", "sequence_id").limit(n).withColumn("end", F.lit("shortest")))


def year_by_split(images: DataFrame, splits: tuple[str, ...] = ("database", "query", "train")) -> DataFrame:
    """Pivot of capture year by split, 0 where there is no image."""
    rows = images.where(F.col("captured_at").isNotNull() & F.col("split").isin(list(splits)))
    year = F.year(F.timestamp_millis("captured_at")).cast("long").alias("year")
    return rows.groupBy(year).pivot("split", list(splits)).count().fillna(0, list(splits))


def split_consistency(images: DataFrame) -> DataFrame:
    """Per sequence: number of splits and the split it has if there is just one."""
    rows = images.where("sequence_id is not null").groupBy("sequence_id").agg(F.count("*").alias("n_images"), F.countDistinct("split").alias("n_splits"), F.min("split").alias("low"))
    return rows.select("sequence_id", "n_images", "n_splits", F.when(F.col("n_splits") == 1, F.col("low")).alias("split"))


def neighbourhood(near: DataFrame) -> DataFrame:
    """Per query with a neighbour: count, same creator on the same day, other creator, fewest days apart."""
    same = F.col("q_creator") == F.col("r_creator")
    days = F.abs(F.col("q_at") - F.col("r_at")) / DAY_MS
    return near.groupBy("query_id").agg(
        F.count("*").alias("n_near"), F.coalesce(F.bool_or(same & (days < 1)), F.lit(False)).alias("same_creator_same_day"),
        F.coalesce(F.bool_or(~same), F.lit(False)).alias("other_creator"), F.min(days).alias("min_days"),
    )


def neighbourhood_summary(per_query: DataFrame) -> DataFrame:
    """Shares and medians over all queries; the medians are exact and no task holds all values."""
    rows = stage(per_query, "neighbourhood")
    near, days = (exact_quantiles(rows, c, [0.5])[0] for c in ("n_near", "min_days"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    out = rows.agg(F.count("*").alias("n_queries"), share("same_creator_same_day").alias("same_day_share"), share("other_creator").alias("other_creator_share"))
    return out.select("n_queries", F.lit(near).cast("double").alias("median_near"), "same_day_share", "other_creator_share", F.lit(days).cast("double").alias("median_min_days"))


def creator_concentration(images: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` creators with their share and the running share of all images with a creator."""
    per = images.where("creator_id is not null").groupBy("creator_id").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).scalar()
    best = per.orderBy(F.desc("n"), "creator_id").limit(top).withColumn("total", total)
    along = Window.orderBy(F.desc("n"), "creator_id").rowsBetween(Window.unboundedPreceding, 0)  # over ``top`` rows
    return best.select("creator_id", "n", (F.col("n") / F.col("total")).alias("share"), (F.sum("n").over(along) / F.col("total")).alias("running_share"))


def survey(images: DataFrame, since_year: int = 2022) -> DataFrame:
    """One row per split: images, sequences, creators, recent share, panorama share (unknowns left out)."""
    year = F.year(F.timestamp_millis("captured_at"))
    return images.groupBy("split").agg(
        F.count("*").alias("n_images"), F.countDistinct("sequence_id").alias("n_sequences"), F.countDistinct("creator_id").alias("n_creators"),
        F.avg((year >= since_year).cast("double")).alias("recent_share"), F.avg(F.col("is_pano").cast("double")).alias("pano_share"),
    )


def grid_density(images: DataFrame, cell: float, lat: Column | str = "lat", lon: Column | str = "lon") -> DataFrame:
    """Placed images per grid cell of ``cell`` degrees (P14, and the counts behind A33)."""
    at = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / cell).alias
    return images.where("placed").groupBy(at(lat)("cell_lat"), at(lon)("cell_lon")).agg(F.count("*").alias("n"))


def densest_cell(images: DataFrame, cell: float) -> DataFrame:
    return grid_density(images, cell).orderBy(F.desc("n"), "cell_lat", "cell_lon").limit(1)


def list_overlap(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``rows``, how many are in ``other``, and their share."""
    left = rows.where(F.col(key).isNotNull()).select(key).distinct()
    flagged = left.join(other.select(key).distinct().withColumn("there", F.lit(1)), key, "left")
    return flagged.agg(F.count("*").alias("n_keys"), F.count("there").alias("n_common"), F.try_divide(F.count("there"), F.count("*")).alias("share"))


def missing_keys(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys of ``expected`` that ``present`` lacks."""
    return expected.where(F.col(key).isNotNull()).select(key).distinct().join(present.select(key), key, "left_anti")


def missing_fraction(expected: DataFrame, present: DataFrame, key: str, most: float | None = None) -> dict:
    """Expected, present and missing counts; raises if the missing share exceeds ``most``."""
    n = expected.select(key).distinct().count()
    gone = missing_keys(expected, present, key).count()
    share = gone / n if n else 0.0
    if most is not None and share > most:
        raise ValueError(f"{gone} of {n} are missing ({share:.1%}), more than {most:.1%}")
    return {"expected": n, "present": n - gone, "missing": gone, "fraction": share}
