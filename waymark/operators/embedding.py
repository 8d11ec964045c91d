"""The encoder plug-in: anything that turns image bytes into vectors (inventory 2.14)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """An encoder with a fixed output size; ``close`` frees what it holds."""

    dim: int

    def embed(self, images: list[bytes]) -> np.ndarray: ...

    def close(self) -> None: ...


class HashEmbedder:
    """Deterministic vectors from a hash of the bytes, for tests."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def embed(self, images: list[bytes]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(b).digest()[:8], "big") for b in images]
        return np.stack([np.random.default_rng(s).normal(size=self.dim) for s in seeds]) if seeds else np.zeros((0, self.dim))

    def close(self) -> None:
        pass


def embed_images(images: DataFrame, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """``image_id, vec, error`` for ``image_id, content``: unit vectors, one encoder per task.

    An image the encoder can't read gets a null vector and the error; the others of its
    batch are encoded one by one. Null content is an error, a zero vector stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()

        def encode(blobs: list[bytes]) -> list:
            x = np.asarray(encoder.embed(blobs), dtype=np.float64).reshape(len(blobs), encoder.dim)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            return (x / np.where(n > 0, n, 1.0)).astype(np.float32).tolist()

        try:
            for rows in batches:
                ids, blobs = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                for a in range(0, len(ids), batch):
                    part = [b for b in blobs[a : a + batch]]
                    vectors: list = [None] * len(part)
                    errors: list = ["no content" if b is None else None for b in part]
                    good = [i for i, b in enumerate(part) if b is not None]
                    try:
                        for i, v in zip(good, encode([part[i] for i in good])):
                            vectors[i] = v
                    except Exception:
                        for i in good:
                            try:
                                vectors[i] = encode([part[i]])[0]
                            except Exception as e:
                                errors[i] = f"{type(e).__name__}: {e}"
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a : a + batch], pa.int64()), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["image_id", "vec", "error"]
                    )
        finally:
            encoder.close()

    return images.select("image_id", "content").mapInArrow(run, "image_id long, vec array<float>, error string")


def resume(images: DataFrame, make: Callable[[], Embedder], path: str, batch: int = 64) -> DataFrame:
    """Encodes what ``path`` lacks, appends it there, and returns all that is there.

    Images without a vector (an error) are tried again. Each run's rows become visible
    together, so a run that fails leaves only what earlier runs finished; an image that two
    runs encoded at once counts once.
    """
    spark = images.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    left = images
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        left = images.join(spark.read.parquet(path).where("vec is not null").select("image_id"), "image_id", "left_anti")
    embed_images(left, make, batch).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("image_id").agg(F.max_by("vec", F.col("vec").isNotNull()).alias("vec"), F.min("error").alias("error")).where("vec is not null or error is not null")
