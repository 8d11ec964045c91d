"""Exact nearest neighbours of a set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import haversine

#: Most queries that are broadcast, queries that travel together, and queries scored at a time.
QUERY_BLOCK = 4096
#: References that travel together and are scored at a time, which bounds the matrix of similarities.
REFERENCE_BLOCK = 2048


def top_k(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest of each row, ties to the smaller id, in order."""
    k = min(k, sims.shape[1])
    if not k:
        return ids[:, :0], sims[:, :0]
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sims, best, 1).min(1)
    # Where more than k reach the least value kept, the partition chose among ties by chance.
    for row in np.flatnonzero((sims >= least[:, None]).sum(1) > k):
        reach = np.flatnonzero(sims[row] >= least[row])
        best[row] = reach[np.lexsort((ids[row, reach], -sims[row, reach]))[:k]]
    found, kept = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
    order = np.lexsort((found, -kept), axis=1)
    return np.take_along_axis(found, order, 1), np.take_along_axis(kept, order, 1)


def _true(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero``, which looks at eight at a time where few are true."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (8 * np.flatnonzero(flat.view(np.uint64))[:, None] + np.arange(8)).ravel()
    return at[flat[at]]


def _running_best(ids: np.ndarray, q: np.ndarray, k: int, few: int = QUERY_BLOCK, many: int = REFERENCE_BLOCK):
    """Keeps the ``k`` best references of each query while they come by, in cells of ``few`` queries and ``many`` references.

    Single precision and a bound of its error say which references may reach a list; those are scored in double precision.
    """
    names, best = np.zeros((len(ids), k), dtype=np.int64), np.full((len(ids), k), -np.inf)
    single, longest = q.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", q, q).max())

    def cell(own: slice, here: np.ndarray, x: np.ndarray, lean: np.ndarray, slack: float, same: np.ndarray) -> None:
        sims = single[own] @ lean.T
        if len(same):
            row, column = np.nonzero(ids[own, None] == here[same])
            sims[row, same[column]] = -np.inf
        floor = best[own, -1]
        if len(here) > k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k])
        rows, columns = np.divmod(_true(sims >= (floor - slack).astype(np.float32)[:, None]), len(here))
        if not len(rows):
            return
        exact = np.round(np.einsum("ij,ij->i", q[own][rows], x[columns]), 9)
        exact[np.isneginf(sims[rows, columns])] = -np.inf
        some, first, n = np.unique(rows, return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(some)), n), np.arange(len(rows)) - np.repeat(first, n)
        new_names, new = np.zeros((len(some), n.max()), dtype=np.int64), np.full((len(some), n.max()), -np.inf)
        new_names[at], new[at] = here[columns], exact
        some = some + own.start
        names[some], best[some] = top_k(np.concatenate([names[some], new_names], axis=1), np.concatenate([best[some], new], axis=1), k)

    def see(here: np.ndarray, x: np.ndarray) -> None:
        for i in range(0, len(here), many):
            some, y = here[i : i + many], x[i : i + many]
            # Of the products' rounding errors, twice, and of the rounding to 9 decimals.
            slack = (y.shape[1] + 8) * 2.0**-22 * longest * np.sqrt(np.einsum("ij,ij->i", y, y).max()) + 1e-9
            lean, same = y.astype(np.float32), np.flatnonzero(np.isin(some, ids))
            for j in range(0, len(ids), few):
                cell(slice(j, j + few), some, y, lean, slack, same)

    def rows() -> pa.RecordBatch:
        ok = np.isfinite(best)
        return pa.RecordBatch.from_arrays([pa.array(ids[np.nonzero(ok)[0]]), pa.array(names[ok]), pa.array(best[ok])], names=["query_id", "ref_id", "sim"])

    return see, rows


def _matrix(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _scorer(shared, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see, rows = _running_best(*shared.value, k)
        for batch in batches:
            if batch.num_rows:
                see(batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), batch.num_rows))
        yield rows()

    return score


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a[:n].tobytes()], pa.binary()) for a in (ids, x)], names=["ids", "vecs"])

        ids, x = np.zeros(0, dtype=np.int64), np.zeros((0, 0))
        for batch in batches:
            if batch.num_rows:
                new, y = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), batch.num_rows)
                ids, x = (np.concatenate([ids, new]), np.concatenate([x, y])) if len(ids) else (new, y)
            while len(ids) >= size:
                yield packed(size)
                ids, x = ids[size:], x[size:]
        if len(ids):
            yield packed(size)

    return pack


def _packed(df: DataFrame, size: int, prefix: str) -> DataFrame:
    """Blocks of up to ``size`` vectors of one partition, each block a row of bytes."""
    rows = df.select("image_id", "vec").mapInArrow(_packer(size), "ids binary, vecs binary")
    return rows.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("ids", "vecs")])


def _pair_scorer(k: int, few: int, many: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {}
        for batch in batches:
            for asks, queries, names, x in zip(*batch.columns):
                name = asks.as_py()
                if name not in kept:
                    ids = np.frombuffer(name, dtype=np.int64)
                    kept[name] = _running_best(ids, np.array(np.frombuffer(queries.as_buffer())).reshape(len(ids), -1), k, few, many)
                here = np.frombuffer(names.as_buffer(), dtype=np.int64)
                kept[name][0](here, np.frombuffer(x.as_buffer()).reshape(len(here), -1))
        for _, rows in kept.values():
            yield rows()

    return score


def merged_lists(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all partial lists ``query_id, ref_id, sim`` of each query (K3, K5).

    The ranking window is limited before its shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "ref_id"))
    return lists.select("query_id", "ref_id", "sim").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "sim")


def exact_topk(queries: DataFrame, references: DataFrame, k: int, block: int = QUERY_BLOCK, cell_queries: int = QUERY_BLOCK, cell_references: int = REFERENCE_BLOCK) -> DataFrame:
    """``query_id, rank, ref_id, sim``: the ``k`` most similar references of every query.

    Both have ``image_id`` and a unit ``vec``. Up to ``block`` queries are broadcast. More
    are sent once into groups, and each group meets every slice of the references in one
    task of a Cartesian product, which reads both where they are: no vector is copied by
    the number of groups, slices or cells. A task scores cells of ``cell_queries`` and
    ``cell_references``, keeps one list a query, and lists of a query's slices are merged
    by a ranking window; slices are so few that lists take a quarter of the references' room.
    One job either way, however many queries there are.
    Similarities are rounded to 9 decimals, ties go to the smaller id, an image isn't its
    own neighbour, and lists are shorter than ``k`` where there are fewer references.
    """
    spark = queries.sparkSession
    n, dim = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n or k < 1:
        return spark.createDataFrame([], "query_id long, rank long, ref_id long, sim double")
    found = "query_id long, ref_id long, sim double"
    if n <= block:
        rows = queries.select("image_id", "vec").toPandas()
        shared = spark.sparkContext.broadcast((rows["image_id"].to_numpy(dtype=np.int64), np.stack(rows["vec"].to_numpy()).astype(np.float64)))
        return merged_lists(references.select("image_id", "vec").mapInArrow(_scorer(shared, k), found), k)
    # An entry of a list takes three numbers, a reference one for each dimension.
    slices = min(max(1, references.count() * dim // (4 * 3 * k * n)), 2**31 - 1)
    groups = queries.repartition(-(-n // QUERY_BLOCK), "image_id")
    pairs = _packed(references.coalesce(slices), REFERENCE_BLOCK, "ref").hint("shuffle_replicate_nl").crossJoin(_packed(groups, 2 * QUERY_BLOCK, "query"))
    pairs = pairs.select("query_ids", "query_vecs", "ref_ids", "ref_vecs")
    return merged_lists(pairs.mapInArrow(_pair_scorer(k, cell_queries, cell_references), found), k)


def locate(queries: DataFrame, references: DataFrame, images: DataFrame, k: int = 10) -> DataFrame:
    """For each query vector the best coordinate, its similarity, margin and spread.

    Queries whose vector is null or of another length than the references' come out with
    ``error`` set, so one bad photo doesn't spoil a batch. ``k`` is at least 2.
    """
    if k < 2:
        raise ValueError("k must be at least 2, for the margin compares two hits")
    dim = F.size("vec")
    width = references.agg(F.max(dim)).scalar()
    checked = queries.withColumn("dim", width).withColumn("error", F.when(F.col("vec").isNull() | (dim != F.col("dim")), F.lit("no vector of the references' length")))
    good = checked.where("error is null").select("image_id", "vec")
    found = exact_topk(good, references, k).join(images.select(F.col("image_id").alias("ref_id"), "lat", "lon"), "ref_id")
    top = found.where("rank = 1").select("query_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    away = haversine("lat1", "lon1", "lat", "lon")
    answer = found.join(top, "query_id").groupBy("query_id", "lat1", "lon1").agg(
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("confidence"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("second"), F.max(away).alias("spread_m"),
    )
    answer = answer.select("query_id", F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), "confidence", (F.col("confidence") - F.col("second")).alias("margin"), "spread_m")
    return checked.select(F.col("image_id").alias("query_id"), "error").join(answer, "query_id", "left")
