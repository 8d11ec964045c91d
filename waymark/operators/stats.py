"""Cluster bootstrap, paired differences, rank correlation and record arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.sources.staging import stage

#: Clusters that a task resamples.
LANE_ROWS = 100_000


def cluster_sums(flags: DataFrame, cluster: str, threshold_m: float = 25.0, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Per cluster the solvable queries and the hits at each k."""
    ok = F.col("nearest_m") <= threshold_m
    return flags.groupBy(cluster).agg(F.count_if(ok).alias("n_solvable"), *[F.count_if(ok & (F.col(f"rank_{threshold_m:g}") <= k)).alias(f"hits_{k}") for k in ks])


def resampled(sums: DataFrame, cluster: str, columns: Sequence[str], n_draws: int, seed: int, lane_rows: int = LANE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``columns`` over ``n_draws`` samples of the clusters with replacement, and over all of them.

    Clusters lie in lanes of about ``lane_rows``, fixed by their names. How many of a
    sample's clusters come from which lane is one multinomial draw; a task then draws that
    many from its lane with a generator keyed by seed and lane (by the seed alone where one
    lane holds all, which gives numpy's draws over the sorted clusters). Together that is
    sampling with replacement from all clusters; ``n_draws`` rows reach the driver.
    """
    table = stage(sums.select(F.col(cluster).cast("string").alias("_cluster"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]), "clusters")
    names = [f"_{i}" for i in range(len(columns))]
    n, *whole = table.agg(F.count("*"), *[F.sum(c) for c in names]).first()
    if not n:
        return np.zeros((0, len(columns))), np.zeros(len(columns))
    lanes = -(-n // lane_rows)
    table = table.withColumn("_lane", F.pmod(F.xxhash64("_cluster"), F.lit(lanes)))
    sizes = {r["_lane"]: r["count"] for r in table.groupBy("_lane").count().collect()}  # as many as there are lanes
    order = sorted(sizes)
    share = np.random.default_rng(seed).multinomial(n, [sizes[i] / n for i in order], size=n_draws)
    taken = table.sparkSession.sparkContext.broadcast({lane: share[:, i] for i, lane in enumerate(order)})

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        lane = int(rows["_lane"].iloc[0])
        x = rows.sort_values(["_cluster", *names])[names].to_numpy()
        rng = np.random.default_rng([seed, lane] if lanes > 1 else seed)
        out = [np.bincount(rng.integers(0, len(x), size=m), minlength=len(x)) @ x for m in taken.value[lane]]
        return pd.DataFrame(np.array(out), columns=names).assign(_draw=np.arange(len(out)))

    drawn = table.groupBy("_lane").applyInPandas(draw, ", ".join(f"{c} double" for c in names) + ", _draw long")
    rows = drawn.groupBy("_draw").agg(*[F.sum(c).alias(c) for c in names]).orderBy("_draw").toPandas()
    return rows[names].to_numpy(), np.array(whole, dtype=float)


def _recalls(sums: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums[..., 1:] / sums[..., :1]


def _columns(ks: Sequence[int]) -> list[str]:
    return ["n_solvable", *[f"hits_{k}" for k in ks]]


def bootstrap(sums: DataFrame, cluster: str, ks: Sequence[int] = (1, 5, 10), n_draws: int = 1000, seed: int = 42, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Recall at each k with its 95 % interval over resampled clusters."""
    samples, whole = resampled(sums, cluster, _columns(ks), n_draws, seed, lane_rows)
    if not whole[0]:
        raise ValueError("no solvable queries to resample")
    rows = []
    for k, p, drawn in zip(ks, _recalls(whole), _recalls(samples).T):
        low, high = np.nanpercentile(drawn, [2.5, 97.5])
        rows.append((k, float(p), float(low), float(high), float((high - low) / 2), float(1.96 * np.sqrt(p * (1 - p) / whole[0]))))
    return sums.sparkSession.createDataFrame(rows, "k int, recall double, low double, high double, half_width double, naive_half_width double")


def paired_difference(a: DataFrame, b: DataFrame, cluster: str, ks: Sequence[int] = (1, 5, 10), n_draws: int = 1000, seed: int = 42, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Difference b - a on identical draws, its interval, and whether that includes 0.

    Both tables must have the same clusters, each once.
    """
    own = _columns(ks)
    both = a.select(F.col(cluster), *[F.col(c).alias(f"a_{c}") for c in own]).join(b.select(F.col(cluster).alias("_other"), *[F.col(c).alias(f"b_{c}") for c in own]), F.col(cluster).eqNullSafe(F.col("_other")), "full")
    both = stage(both, "pairs")
    if both.where("a_n_solvable is null or b_n_solvable is null").limit(1).count():
        raise ValueError("both sides must have the same clusters")
    samples, whole = resampled(both, cluster, [f"{side}_{c}" for side in "ab" for c in own], n_draws, seed, lane_rows)
    if not whole[0] or not whole[len(own)]:
        raise ValueError("no solvable queries to resample")
    of = lambda x: _recalls(x[..., len(own) :]) - _recalls(x[..., : len(own)])
    rows = []
    for k, p, drawn in zip(ks, of(whole), of(samples).T):
        low, high = np.nanpercentile(drawn, [2.5, 97.5])
        rows.append((k, float(p), float(low), float(high), bool(low <= 0.0 <= high)))
    return a.sparkSession.createDataFrame(rows, "k int, difference double, low double, high double, includes_zero boolean")


def squared_rank_differences(n: int) -> np.ndarray:
    """How many orders of ``n`` ranks have each sum of squared differences to the natural order.

    Ranks are handed out one position after another; a state is the set of ranks given away.
    """
    most = n * (n * n - 1) // 3
    ways = {0: np.eye(1, most + 1, dtype=np.int64)[0]}
    for position in range(n):
        following: dict[int, np.ndarray] = {}
        for used, sums in ways.items():
            for rank in range(n):
                if not used >> rank & 1:
                    shift = (rank - position) ** 2
                    into = following.setdefault(used | 1 << rank, np.zeros(most + 1, dtype=np.int64))
                    into[shift:] += sums[: most + 1 - shift]
        ways = following
    return ways[(1 << n) - 1]


def spearman_exact(x: Sequence[float], y: Sequence[float], most: int = 8) -> tuple[float | None, float | None]:
    """Rank correlation without tie averaging, and its exact two-sided p for up to ``most`` points.

    p is the share of all orders with a correlation at least as strong, from the counts of
    every possible sum of squared rank differences; below 3 points both are None.
    """
    n = len(x)
    if n < 3:
        return None, None
    rank = [sorted(range(n), key=lambda i: (float(v[i]), i)) for v in (x, y)]
    place = [{i: r for r, i in enumerate(order)} for order in rank]
    total = sum((place[0][i] - place[1][i]) ** 2 for i in range(n))
    scale = n * (n * n - 1)
    rho = (scale - 6 * total) / scale
    if n > most:
        return rho, None
    counts = squared_rank_differences(n)
    strong = np.abs(scale - 6 * np.arange(len(counts))) >= abs(scale - 6 * total)
    return rho, float(counts[strong].sum() / counts.sum())


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """A29, districts: Spearman's correlation with ties averaged, ranks from counts per value.

    A value's rank follows from the numbers of smaller and equal values, so the window runs
    over distinct values.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str, name: str) -> DataFrame:
        per = rows.groupBy(c).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return per.select(c, (upto - (F.col("n") - 1) / 2).alias(name))

    ranked = rows.select(x, y).join(ranks(x, "rx"), x).join(ranks(y, "ry"), y)
    return ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def hard_drop(records: DataFrame) -> DataFrame:
    """What R@1 loses under the hard definition, from counts.

    ``records``: ``n_correct, duplicate_share, n_solvable, n_solvable_hard``. ``expected_hard`` is
    the identity ``n_correct (1 - duplicate_share) / n_solvable_hard``.
    """
    recall = F.try_divide(F.col("n_correct"), F.col("n_solvable"))
    kept = F.col("n_correct") * (1 - F.col("duplicate_share"))
    return records.withColumn("recall", recall).withColumn("expected_hard", F.try_divide(kept, F.col("n_solvable_hard"))).withColumn("drop", F.col("recall") - F.col("expected_hard"))


def panorama_recall(records: DataFrame) -> DataFrame:
    """Recall of panorama queries as the difference of two evaluations, with its binomial error.

    ``records``: ``n_all, hits_all, n_nopano, hits_nopano``.
    """
    n, h = F.col("n_all") - F.col("n_nopano"), F.col("hits_all") - F.col("hits_nopano")
    p = F.try_divide(h, n)
    return records.withColumn("n_pano", n).withColumn("recall_pano", p).withColumn("std_error", F.sqrt(F.try_divide(p * (1 - p), n)))


def compare_groups(records: DataFrame, group: str, variant: str, value: str) -> DataFrame:
    """Per variant the number of groups, least, greatest value, range, and groups it wins (ties win)."""
    best = records.groupBy(group).agg(F.max(value).alias("best"))
    rows = records.join(best, group)
    return rows.groupBy(variant).agg(
        F.count(value).alias("n_groups"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        (F.max(value) - F.min(value)).alias("range"), F.count_if(F.col(value) == F.col("best")).alias("n_wins"),
    )
