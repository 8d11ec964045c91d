"""Problem 4: a reproducible sample whose members stay as data grows.

Epoch-rate selection: each record belongs to the epoch (UTC month) in which it was first
seen; the epoch's rate is frozen when it begins, from what was seen before it; and the
record is in the sample if a counter-based random number keyed by its identifier lies
below that rate. Rows with a later arrival time change neither an old record's epoch nor
an old epoch's rate, so no member is ever lost, and nothing depends on order, partitions
or reruns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_MASK = 0xFFFFFFFF
#: Fixed values of Threefry-2x32: rotations and key parity.
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
PARITY = 0x1BD11BDA
#: Pieces of the persisted state that are merged into one.
COMPACT = 16


def threefry2x32(k0: np.ndarray, k1: np.ndarray, c0: int, c1: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Both words of Threefry-2x32 for many keys and one counter, all words of 32 bits."""
    word = lambda v: np.asarray(v).astype(np.uint32)
    words = [word(k0), word(k1)]
    words.append(words[0] ^ words[1] ^ np.uint32(PARITY))
    x0, x1 = words[0] + np.uint32(c0), words[1] + np.uint32(c1)
    for r in range(rounds):
        by = np.uint32(ROTATIONS[r % 8])
        x0 = x0 + x1
        x1 = ((x1 << by) | (x1 >> np.uint32(32 - by))) ^ x0
        if r % 4 == 3:
            i = (r + 1) // 4
            x0, x1 = x0 + words[i % 3], x1 + words[(i + 1) % 3] + np.uint32(i)
    return x0, x1


def keyed_uniform(key: Column, seed: int = 0, stream: int = 0) -> Column:
    """Uniform number in [0, 1) with 53 bits, keyed by a bigint identifier; null for null.

    Twenty rounds on whole Arrow batches: as an expression they would be folded row by row,
    for a generator has no built-in.
    """

    @F.pandas_udf("double")
    def draw(keys: pd.Series) -> pd.Series:
        number = keys.to_numpy().view(np.uint64)
        x0, x1 = threefry2x32(number & np.uint64(_MASK), number >> np.uint64(32), seed & _MASK, stream & _MASK)
        return pd.Series((x0.astype(np.float64) * 2097152.0 + (x1 >> np.uint32(11))) / 9007199254740992.0)

    # Without nulls in it a batch stays one of 64-bit integers.
    return F.when(key.isNotNull(), draw(F.coalesce(key, F.lit(0).cast("long"))))


def first_seen(rows: DataFrame, key: str, arrived: str = "ingested_at") -> DataFrame:
    """``key, epoch``: the month (yyyy-MM, session time zone) of each key's earliest arrival.

    Repeated deliveries count once; rows without key or arrival time don't count.
    """
    seen = rows.where(F.col(key).isNotNull() & F.col(arrived).isNotNull()).groupBy(key).agg(F.min(arrived).alias("_first"))
    return seen.select(key, F.date_format("_first", "yyyy-MM").alias("epoch"))


def freeze_rates(seen: DataFrame, target: int, base_rate: float, frozen: DataFrame | None = None) -> DataFrame:
    """``epoch, seen_before, rate`` of every epoch of ``seen``.

    The rate is ``min(base_rate, target / seen_before)``, so that later epochs of a
    growing table add less. Epochs in ``frozen`` keep their stored row.
    """
    counts = seen.groupBy("epoch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = counts.withColumn("seen_before", before).select("epoch", "seen_before", F.least(F.lit(float(base_rate)), F.try_divide(F.lit(float(target)), F.col("seen_before"))).alias("rate"))
    return fresh if frozen is None else frozen.unionByName(fresh.join(frozen.select("epoch"), "epoch", "left_anti"))


def select(seen: DataFrame, rates: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Members of the sample: ``key, epoch, rate, u``. A string key is digested to 60 bits."""
    number = F.conv(F.substring(F.md5(F.col(key)), 1, 15), 16, 10).cast("long") if dict(seen.dtypes)[key] == "string" else F.col(key).cast("long")
    return seen.join(rates.select("epoch", "rate"), "epoch").withColumn("u", keyed_uniform(number, seed)).where("u < rate").select(key, "epoch", "rate", "u")


def stable_sample(rows: DataFrame, key: str, target: int = 20_000, base_rate: float = 0.05, seed: int = 0, arrived: str = "ingested_at") -> DataFrame:
    """The sample of ``rows`` by ``key``; empty input gives an empty sample."""
    seen = first_seen(rows, key, arrived)
    return select(seen, freeze_rates(seen, target, base_rate), key, seed)


class SampleState:
    """First-seen epochs and frozen rates kept as Parquet tables under ``path``.

    ``advance`` takes in a delivery: keys never seen before are appended as one more piece
    (old pieces aren't rewritten; only a delivery's own keys are shuffled against them),
    epochs get their rate once. Each generation ends with a list of its pieces, written
    last, so a failed run leaves the state as it was. After ``COMPACT`` pieces they are
    merged into one; what the newest two generations don't name is deleted.
    """

    def __init__(self, spark, path: str, target: int = 20_000, base_rate: float = 0.05, seed: int = 0):
        self.spark, self.path, self.target, self.base_rate, self.seed = spark, path.rstrip("/"), target, base_rate, seed

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _names(self) -> list[str]:
        _, files, root = self._files()
        return [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []

    def _generation(self) -> int:
        path, files, _ = self._files()
        done = [n for n in self._names() if n.startswith("pieces-") and files.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        return max([int(n.removeprefix("pieces-")) for n in done], default=0)

    def _pieces(self, generation: int) -> list[str]:
        return [r["piece"] for r in self.spark.read.parquet(f"{self.path}/pieces-{generation}").collect()] if generation else []

    def seen(self, pieces: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in pieces])

    def advance(self, rows: DataFrame, key: str, arrived: str = "ingested_at") -> DataFrame:
        """Take in new rows and return the sample of everything seen so far."""
        at = self._generation()
        pieces, frozen = self._pieces(at), None
        fresh = first_seen(rows, key, arrived)
        if at:
            frozen = self.spark.read.parquet(f"{self.path}/rates-{at}")
            # The delivery is written before it is joined, so that its size is known and decides how.
            fresh = self._write(fresh, f"delivery-{at + 1}")
            known = self.seen(pieces).join(fresh.select(key), key, "left_semi").select(key)
            fresh = fresh.join(known, key, "left_anti")
        self._write(fresh, f"seen-{at + 1}")
        pieces.append(f"seen-{at + 1}")
        if len(pieces) > COMPACT:
            self._write(self.seen(pieces), f"merged-{at + 1}")
            pieces = [f"merged-{at + 1}"]
        seen = self.seen(pieces)
        rates = self._write(freeze_rates(seen, self.target, self.base_rate, frozen), f"rates-{at + 1}")
        self._write(self.spark.createDataFrame([(p,) for p in pieces], "piece string").coalesce(1), f"pieces-{at + 1}")
        self._forget(at)
        return select(seen, rates, key, self.seed)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _forget(self, before: int) -> None:
        path, files, _ = self._files()
        kept = {p for g in (before, before + 1) for p in [*self._pieces(g), f"rates-{g}", f"pieces-{g}"]}
        for name in set(self._names()) - kept:
            files.delete(path(f"{self.path}/{name}"), True)
