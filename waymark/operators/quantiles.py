"""Exact quantiles of a whole column, distributed.

The built-in exact percentile gathers all distinct values of a group in one task. Here a
histogram narrows down the interval of each wanted rank, round by round, until only few
values are left in it; every round is an aggregate with a fixed number of groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: Values of an interval that are fetched at last.
FEW = 20_000


def _ranked(values: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values of the given ranks (from 0) of the column ``v``."""
    found: dict[int, float] = {}
    low, high = values.agg(F.min("v"), F.max("v")).first()
    todo = [(low, high, 0, n, sorted(set(ranks)))]
    while todo:
        low, high, before, inside, wanted = todo.pop()
        if low == high:
            found |= {r: low for r in wanted}
            continue
        here = values.where(F.col("v").between(low, high))
        width = (high - low) / BINS
        if inside <= FEW or low + width == low:
            # Distinct values with their counts, so that ties don't add up.
            rows = here.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect() if inside <= FEW else here.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").toLocalIterator()
            at = before
            for row in rows:
                found |= {r: row["v"] for r in wanted if at <= r < at + row["n"]}
                at += row["n"]
            continue
        bin_ = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        at = before
        for row in here.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect():
            mine = [r for r in wanted if at <= r < at + row["n"]]
            if mine:
                todo.append((row["lo"], row["hi"], at, row["n"], mine))
            at += row["n"]
    return found


def exact_quantiles(df: DataFrame, value: Column | str, quantiles: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, as the built-in ``percentile`` gives.

    Nulls and NaN don't count; without any value the quantiles are None. ``df`` is scanned
    a few times, so stage it first if it is costly.
    """
    values = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return [None] * len(quantiles)
    places = [q * (n - 1) for q in quantiles]
    at = _ranked(values, [r for p in places for r in (math.floor(p), math.ceil(p))], n)
    out = []
    for p in places:
        a, b = at[math.floor(p)], at[math.ceil(p)]
        out.append(a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b)
    return out
