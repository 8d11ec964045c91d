"""Descriptor tables: cleaning, checks, projections and concatenation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import vectors


def clean(descriptors: DataFrame, dim: int, id_col: str = "image_id", vec_col: str = "vec") -> DataFrame:
    """``image_id, vec array<double>`` of unit norm: one usable vector per id.

    Null, short, long, zero, NaN and infinite vectors are left out; of several vectors of
    one id the greatest counts.
    """
    rows = descriptors.select(F.col(id_col).alias("image_id"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("image_id").isNotNull() & (F.size("vec") == dim)).where(vectors.finite("vec")).where(F.exists("vec", lambda x: x != 0))
    return rows.groupBy("image_id").agg(F.max("vec").alias("vec")).select("image_id", vectors.l2_normalized("vec").alias("vec"))


def norm_report(descriptors: DataFrame, vec_col: str = "vec") -> DataFrame:
    """V3: rows, null, non-finite and zero vectors, and least, mean and greatest norm of the finite ones."""
    ok = F.col(vec_col).isNotNull() & vectors.finite(vec_col)
    n = F.when(ok, vectors.norm(vec_col))
    return descriptors.agg(
        F.count("*").alias("n"), F.count_if(F.col(vec_col).isNull()).alias("n_null"), F.count_if(F.col(vec_col).isNotNull() & ~ok).alias("n_not_finite"),
        F.count_if(n == 0).alias("n_zero"), F.min(n).alias("min_norm"), F.avg(n).alias("mean_norm"), F.max(n).alias("max_norm"),
    )


@dataclass
class Projection:
    """Mean, components (rows) and their variances; ``whiten`` divides by the standard deviation."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    share: float
    whiten: bool = False

    def apply(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.components.T
        if self.whiten:
            y = y / np.sqrt(np.maximum(self.variances, 1e-12))
        n = np.linalg.norm(y, axis=1, keepdims=True)
        return y / np.where(n > 0, n, 1.0)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
        x = np.concatenate([np.ones((len(x), 1)), x], 1)
        part = x.T @ x
        total = part if total is None else total + part
    if total is not None:
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])


def fit_pca(descriptors: DataFrame, n_components: int, whiten: bool = False, fit_images: int | None = None, seed: int = 42) -> Projection:
    """V4: principal components from sums of products added up in the cluster.

    Only the (dim + 1)^2 sums reach the driver. ``fit_images`` takes about that many rows,
    those whose seeded hash of the id lies below a share of its range. The sign of a component makes its largest entry positive.
    """
    rows = descriptors
    if fit_images is not None:
        share = min(1.0, fit_images / max(rows.count(), 1))
        rows = rows.where(F.pmod(F.xxhash64("image_id", F.lit(seed)), F.lit(1 << 52)) < F.lit(int(share * (1 << 52))))
    sums = rows.select("vec").mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if sums.empty:
        raise ValueError("no vectors to fit on")
    size = int(sums["i"].max()) + 1
    m = np.zeros((size, size))
    m[sums["i"], sums["j"]] = sums["v"]
    n = m[0, 0]
    mean = m[0, 1:] / n
    covariance = (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:n_components]
    components = axes[:, order].T
    components = components * np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])[:, None]
    return Projection(mean, components, values[order], float(values[order].sum() / values.sum()), whiten)


def _row_mapper(shared, key: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            y = np.ascontiguousarray(shared.value(x))
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[key, "vec"])

    return apply


def apply_projection(descriptors: DataFrame, projection: Projection) -> DataFrame:
    """V5: project every vector, L2-normalised."""
    shared = descriptors.sparkSession.sparkContext.broadcast(projection.apply)
    return descriptors.select("image_id", "vec").mapInArrow(_row_mapper(shared, "image_id"), "image_id long, vec array<double>")


class LinearAdapter:
    """V8: ``W x + b`` with unit norm."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = np.asarray(weights, dtype=float), np.asarray(bias, dtype=float)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weights.T + self.bias
        n = np.linalg.norm(y, axis=1, keepdims=True)
        return y / np.where(n > 0, n, 1.0)


def apply_adapter(descriptors: DataFrame, adapter: LinearAdapter) -> DataFrame:
    shared = descriptors.sparkSession.sparkContext.broadcast(adapter)
    return descriptors.select("image_id", "vec").mapInArrow(_row_mapper(shared, "image_id"), "image_id long, vec array<double>")


def mean_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """V6, V8: number of common ids, least and mean cosine of the two versions."""
    pairs = a.select("image_id", F.col("vec").alias("a")).join(b.select("image_id", F.col("vec").alias("b")), "image_id")
    c = vectors.cosine("a", "b")
    return pairs.agg(F.count("*").alias("n"), F.min(c).alias("min_cosine"), F.avg(c).alias("mean_cosine"))


def concat(a: DataFrame, b: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """V7: descriptors side by side for the ids both have; raises if a ``required`` id gets lost."""
    both = a.select("image_id", F.col("vec").alias("a")).join(b.select("image_id", F.col("vec").alias("b")), "image_id")
    if required is not None:
        lost = required.select("image_id").join(a.select("image_id"), "image_id", "left_semi").join(both.select("image_id"), "image_id", "left_anti").limit(1).count()
        if lost:
            raise ValueError("concatenation would lose required images")
    return both.select("image_id", vectors.concatenated("a", "b").alias("vec"))


def stored_similarity_gap(rankings: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Stored similarities scored again: entries, those off by more than 1e-4, greatest gap."""
    q = descriptors.select(F.col("image_id").alias("query_id"), F.col("vec").alias("q_vec"))
    r = descriptors.select(F.col("image_id").alias("ref_id"), F.col("vec").alias("r_vec"))
    gap = F.abs(vectors.dot("q_vec", "r_vec") - F.col("sim"))
    return rankings.where("sim is not null").join(q, "query_id").join(r, "ref_id").agg(F.count("*").alias("n"), F.count_if(gap > 1e-4).alias("n_off"), F.max(gap).alias("max_gap"))
