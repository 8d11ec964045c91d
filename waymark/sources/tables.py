"""Readers for the project's tables and their cleaned views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that may surround identifiers and split names.
BLANKS = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(c: Column | str) -> Column:
    """``c`` without surrounding blanks and tabs; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def split_name(c: Column | str) -> Column:
    """Trimmed lower-case split; null for null and empty."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def newest(df: DataFrame, *columns: str, key: str = "image_id", version: str = "ingested_at") -> DataFrame:
    """The row with the newest ``version`` of each ``key``, reduced to ``columns``.

    An aggregate rather than a window: copies of one key are combined before the
    shuffle, so a key that holds a third of all rows is no hot task. Rows that tie
    on the newest version are resolved to the greatest struct, hence to one row.
    A null key is a key of its own; null versions count as oldest.
    """
    latest = F.max(F.struct(F.col(version), *[F.col(c) for c in columns])).alias("_latest")
    return df.groupBy(key).agg(latest).select(key, *[F.col("_latest")[c].alias(c) for c in columns])


def metadata(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Newest metadata row of each image with the cleaned ``sequence_id`` and ``split``."""
    raw = table(spark, sf_dir, "metadata")
    for name, clean in (("sequence_id", trimmed), ("split", split_name)):
        if name in columns:
            raw = raw.withColumn(name, clean(name))
    return newest(raw, *columns)
