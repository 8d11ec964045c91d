"""Problem 7: texts packed into training sequences of a fixed number of tokens.

Lengths are counted into a histogram, which is all the driver sees. Combinations of up to
three lengths that fill a sequence exactly (all, or evenly spread ones where there are
very many) are the columns of a non-negative least-squares problem whose solution says how often to use each; the counts are rounded down to what the
histogram holds, and what is left is packed greedily, longest first into the tightest gap.
The plan has a size set by the capacity, not by the data. Every text then finds its
sequence by its rank among the texts of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.sources.staging import stage

#: Texts of one length that a task ranks.
LANE_ROWS = 100_000
#: Columns of the least-squares problem.
MOST_COLUMNS = 120_000


def default_vocabulary() -> str:
    """Path of the byte-level BPE ranks for many languages among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n"])

    return count


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``<id_col>, n_tokens`` of every non-null, non-empty text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_counter(vocabulary or default_vocabulary()), f"id {kind}, n long").select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"))


def combinations(lengths: np.ndarray, capacity: int, most: int = MOST_COLUMNS) -> np.ndarray:
    """Rows ``a >= b >= c`` (0 where absent) of the given lengths that add up to ``capacity``.

    About ``most`` of them: where a longest length has many, evenly spread ones are taken.
    """
    lengths = np.unique(lengths[(lengths > 0) & (lengths <= capacity)])
    present = np.zeros(capacity + 1, dtype=bool)
    present[lengths] = True
    whole = lengths[lengths == capacity]
    found = [np.stack([whole, 0 * whole, 0 * whole], 1)]
    pair = lengths[(2 * lengths >= capacity) & (lengths < capacity)]
    pair = pair[present[capacity - pair]]
    found.append(np.stack([pair, capacity - pair, 0 * pair], 1))
    longest = lengths[(3 * lengths >= capacity) & (lengths <= capacity - 2)]
    each = max(8, most // max(len(longest), 1))
    for a in longest:
        low, high = np.searchsorted(lengths, [-(-(capacity - a) // 2), min(a, capacity - a - 1) + 1])
        b = lengths[low:high]
        b = b[present[capacity - a - b]]
        if len(b) > each:
            b = b[np.linspace(0, len(b) - 1, each).astype(np.int64)]
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(found)


def nonnegative_least_squares(columns: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - target|; column j of A counts the lengths in ``columns[j]``.

    Accelerated projected gradient; the matrix is never formed.
    """
    size = len(target)
    flat, live = columns.ravel(), (columns > 0).ravel().astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, columns.shape[1]) * live, minlength=size)

    def backward(r: np.ndarray) -> np.ndarray:
        return (r[flat] * live).reshape(columns.shape).sum(1)

    v = np.ones(len(columns))
    for _ in range(30):
        v = backward(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(columns))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - backward(forward(y) - target) / (1.05 * top))
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (how many texts of which length) with the number of sequences of each.

    ``histogram[n]`` is the number of texts of ``n`` tokens, 1 to ``capacity``. Every text is placed.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    patterns: list[tuple[dict[int, int], int]] = []
    columns = combinations(np.flatnonzero(left), capacity)
    if len(columns):
        solution = nonnegative_least_squares(columns, left / left.sum()) * left.sum()
        for j in np.argsort(-solution, kind="stable"):
            if solution[j] < 0.5:
                break
            need: dict[int, int] = {}
            for n in columns[j]:
                if n:
                    need[int(n)] = need.get(int(n), 0) + 1
            times = min([int(round(solution[j])), *(int(left[n]) // m for n, m in need.items())])
            if times > 0:
                patterns.append((need, times))
                for n, m in need.items():
                    left[n] -= m * times
    gaps: dict[int, list[tuple[dict[int, int], int]]] = {}
    sizes: list[int] = []  # of the gaps, ascending

    def leave(gap: int, pattern: dict[int, int], times: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        gaps[gap].append((pattern, times))

    for n in np.flatnonzero(left)[::-1].tolist():
        waiting = int(left[n])
        while waiting:
            at = bisect_left(sizes, n)
            fits = at < len(sizes)
            gap = sizes[at] if fits else capacity
            pattern, times = gaps[gap].pop() if fits else ({}, waiting // max(1, capacity // n) or 1)
            if fits and not gaps[gap]:
                del gaps[gap], sizes[at]
            each = min(gap // n, waiting)
            used = min(times, waiting // each)
            if used < times and fits:
                leave(gap, pattern, times - used)
            leave(gap - each * n, pattern | {n: pattern.get(n, 0) + each}, used)
            waiting -= each * used
    for group in gaps.values():
        patterns += group
    return patterns


class Seats:
    """Where the r-th text of each length goes, from the plan."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for pattern, times in patterns:
            start = 0
            for n in sorted(pattern, reverse=True):
                for _ in range(pattern[n]):
                    rows.append(((n << 40) + taken.get(n, 0), base, start))
                    taken[n] = taken.get(n, 0) + times
                    start += n
            base += times
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        self.keys, self.bases, self.starts, self.sequences = table[:, 0], table[:, 1], table[:, 2], base

    def find(self, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (n.astype(np.int64) << 40) + rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        return self.bases[at] + key - self.keys[at], self.starts[at]


def pack(docs: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """A sequence and a place in it for every text, see ``pack_counted``. Null and empty texts have no tokens and no row."""
    return pack_counted(token_counts(docs, id_col, text_col, vocabulary), capacity, id_col)


def pack_counted(counted: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """A sequence and a place in it for every row of ``<id_col>, n_tokens``.

    Returns ``<id_col>, piece, n_tokens, sequence, start``. Only a text of more than
    ``capacity`` tokens is split, into full sequences and a rest; the pieces count from 0.
    A repeated id is packed each time it occurs; ties of length are ranked by id. Rows
    without tokens and an empty table give no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)), lambda i: F.least(F.lit(capacity), F.col("n_tokens") - i * capacity))).alias("piece", "n")
    pieces = stage(counted.where("n_tokens > 0").select(F.col(id_col).alias("id"), cut), "pieces")
    lanes = int(max(16, pieces.count() // LANE_ROWS))
    pieces = pieces.withColumn("lane", F.pmod(F.xxhash64("id", "piece"), F.lit(lanes)).cast("int"))
    counts = stage(pieces.groupBy("n", "lane").agg(F.count("*").alias("many")), "lengths")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("n").agg(F.sum("many").alias("many")).collect():  # at most ``capacity`` rows
        histogram[row["n"]] = row["many"]
    seats = counted.sparkSession.sparkContext.broadcast(Seats(plan(histogram, capacity)))

    before = F.coalesce(F.sum("many").over(Window.partitionBy("n").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("n", "lane", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("n", "lane").orderBy("id", "piece"))
    ranked = pieces.withColumn("nth", nth).join(offsets, ["n", "lane"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    @F.pandas_udf("sequence long, start long")
    def seat(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, start = seats.value.find(n.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence": sequence, "start": start})

    return ranked.select(F.col("id").alias(id_col), F.col("piece").cast("long").alias("piece"), F.col("n").alias("n_tokens"), seat("n", "rank").alias("s")).select(id_col, "piece", "n_tokens", "s.sequence", "s.start")


def fill_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: sequences, pieces, tokens, full sequences and the share of room in use."""
    per = packed.groupBy("sequence").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    used = F.coalesce(F.sum("used"), F.lit(0))
    return per.agg(
        F.count("*").alias("n_sequences"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"), used.alias("n_tokens"),
        F.count_if(F.col("used") == capacity).alias("n_full"), F.try_divide(used, F.count("*") * capacity).alias("fill"),
    )
