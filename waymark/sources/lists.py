"""Stored result lists by variant, guarded by the settings they were made with."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from waymark.operators.guard import require_same
from waymark.sources.formats import read_rankings, write_rankings


def list_name(encoder: str, adapter: str | None = None, window: int = 0, full_reference: bool = False) -> str:
    """Name of a variant's lists: ``net``, ``net_linear``, ``net_fullref``, ``net_seq3``."""
    parts = [encoder, adapter, "fullref" if full_reference else None, f"seq{window}" if window else None]
    return "_".join(p for p in parts if p)


def save_lists(rankings: DataFrame, root: str, name: str, settings: Mapping[str, Any]) -> None:
    """Writes the lists and, when they are complete, the settings beside them."""
    write_rankings(rankings, f"{root}/{name}")
    line = json.dumps(dict(settings), sort_keys=True, allow_nan=False)
    rankings.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}.settings")


def load_lists(spark: SparkSession, root: str, settings: Mapping[str, Any], encoder: str, adapter: str | None = None, window: int = 0, full_reference: bool = False, least_width: int = 1) -> DataFrame:
    """The lists of a variant: ``query_id, rank, ref_id, sim``.

    Raises if they were made with other ``settings`` (every difference is named) or if no
    list is ``least_width`` wide, for then a recall at that depth would mean nothing.
    """
    name = list_name(encoder, adapter, window, full_reference)
    stored = json.loads(spark.read.text(f"{root}/{name}.settings").first()["value"])
    require_same(settings, stored, f"the list {name}")
    rows = read_rankings(spark, f"{root}/{name}")
    if not rows.where(rows["rank"] >= least_width).limit(1).count():
        raise ValueError(f"the lists of {name} are less than {least_width} wide")
    return rows
