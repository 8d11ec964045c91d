"""Problem 6: the most similar vectors of every vector.

Vectors go into overlapping blocks: each lies in the block of its best centroid and in
every other block that is hardly further away, so that two neighbours meet in at least
one block though each vector is sent to a few blocks only. How much further is read off
the neighbours within the sample: so far that a share ``MEETING`` of them meet. Within
a block every vector is a query and part of the index at once: the block is cut into
small lists, and a query scans the lists next to its own.

The scan is score-aware anisotropic quantisation: the residual to a list's centroid is
turned onto the axes that hold its energy and split into subspaces of two axes, 16
codewords (four bits) each. Codes are chosen so that the error along the vector itself,
which is what changes an inner product, weighs more than the error across it. Scores are
sums of small integer tables, one row of queries per code, and the best ``keep`` of each
query are scored again exactly in double precision.

The model is fitted on a bounded sample (``SAMPLE_ROWS``); every vector is indexed. Copies
of one vector form a class of which only the k + 1 smallest ids are indexed, which is all
that ties can ever let through; the other copies take over their class's list. A block of
more than ``SPLIT_ROWS`` vectors is cut into a grid of parts, so neither a crowded block
nor a crowd of copies becomes one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.sources.staging import stage

#: Vectors the codebooks are fitted on, chosen by a hash of the id. Blocks take an eighth of all vectors or 32 for
#: each block if that is more, but never more than ``MOST_SAMPLE``.
SAMPLE_ROWS, MOST_SAMPLE = 20_000, 131_072
#: Vectors of the sample whose neighbours say how far blocks must overlap.
JUDGED = 2_000
#: Vectors that a block is the best block of, and most blocks there are; beyond that blocks grow and are split.
BLOCK_ROWS, MAX_BLOCKS = 16_000, 4096
#: Share of neighbours that are to meet in a block, and most blocks a vector is sent to on average.
MEETING, MOST_COPIES = 0.98, 6.0
#: Vectors of a list within a block, and lists a query scans.
LIST_ROWS, PROBES = 64, 192
#: Candidates of a block that are scored exactly, in multiples of k + 1: at first, and where a code that was left out might still belong.
KEEP, MORE = 3, 64
#: Standard deviations of the codes' error by which a code left out must lie below the last neighbour found.
DOUBT = 3.0
#: Vectors of a block beyond which it is split.
SPLIT_ROWS = 65_536
#: Codewords of a subspace (four bits) and axes of one.
CODES, WIDTH = 16, 2
#: Queries scanned at a time, and rows of one tile of the scan.
QUERY_CHUNK, TILE_ROWS = 128, 1024
#: Inner products below this share of the norm don't matter (fixed value of the published method).
SCORE_THRESHOLD = 0.2


@dataclass
class Model:
    """Block centroids, the axes kept (dim x r), codebooks (subspaces x 16 x width), and how much further a second block may be."""

    centroids: np.ndarray
    axes: np.ndarray
    books: np.ndarray
    weight: float
    margin: float

    def blocks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and block of every block that the unit vectors ``x`` are sent to."""
        angle = np.arccos(np.clip(x @ self.centroids.T, -1.0, 1.0))
        return np.nonzero(angle <= angle.min(axis=1, keepdims=True) + self.margin)

    def encode(self, x: np.ndarray, centres: np.ndarray, home: np.ndarray, rounds: int = 1) -> np.ndarray:
        """Codes (n x subspaces) that minimise |r|^2 + (weight - 1) (r.x)^2 by coordinate descent."""
        parts = (x @ self.axes).reshape(len(x), -1, WIDTH)
        residual = parts - (centres @ self.axes)[home].reshape(parts.shape)
        return _codes(residual, parts, self.books, self.weight, rounds)


def _codes(residual: np.ndarray, parts: np.ndarray, books: np.ndarray, weight: float, rounds: int) -> np.ndarray:
    m, n = residual.shape[1], len(residual)
    error = np.stack([(books[j] ** 2).sum(-1) - 2 * residual[:, j] @ books[j].T for j in range(m)])
    along = np.stack([(residual[:, j] * parts[:, j]).sum(-1)[:, None] - parts[:, j] @ books[j].T for j in range(m)])
    codes = error.argmin(-1)
    rows = np.arange(n)
    total = sum(along[j, rows, codes[j]] for j in range(m))
    for _ in range(rounds):
        for j in range(m):
            rest = total - along[j, rows, codes[j]]
            codes[j] = (error[j] + (weight - 1) * (rest[:, None] + along[j]) ** 2).argmin(1)
            total = rest + along[j, rows, codes[j]]
    return codes.T


def _nearest(x: np.ndarray, centres: np.ndarray, penalty: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best centre for each row and its score, in blocks of rows."""
    home, score = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
    for at in range(0, len(x), 2048):
        scores = x[at : at + 2048] @ centres.T - penalty
        home[at : at + 2048] = scores.argmax(1)
        score[at : at + 2048] = scores.max(1)
    return home, score


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        home, score = _nearest(x, centres, 0.0 if spherical else 0.5 * (centres**2).sum(1))
        counts = np.bincount(home, minlength=k)
        used = counts > 0
        order = np.argsort(home, kind="stable")
        sums = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[used], axis=0)
        centres[used] = sums / counts[used, None]
        if (~used).any():  # an empty centre moves to a vector that fits badly
            centres[~used] = x[np.argsort(score)[: (~used).sum()]] if (~used).sum() <= len(x) else x[rng.choice(len(x), (~used).sum())]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _axes(residual: np.ndarray, energy: float) -> np.ndarray:
    """The principal axes that hold ``energy`` of the residuals, each strong one beside a weak one; zeros fill up to a multiple of 4."""
    value, vector = np.linalg.eigh(residual.T.astype(np.float64) @ residual)
    value, vector = np.maximum(value[::-1], 0.0), vector[:, ::-1]
    kept = min(1 + int(np.searchsorted(np.cumsum(value), energy * value.sum())), len(value))
    full = -(-kept // (2 * WIDTH)) * 2 * WIDTH
    axes = np.zeros((len(value), full), dtype=np.float32)
    axes[:, : min(full, len(value))] = vector[:, :full]
    half = np.arange(full // 2)
    return axes[:, np.stack([half, full - 1 - half], 1).ravel()]


def _margin(x: np.ndarray, centroids: np.ndarray, rank: int, meeting: float, most_copies: float) -> float:
    """How much further than its best centroid a block may be, so that ``meeting`` of the neighbours up to ``rank`` share a block."""
    if meeting >= 1.0 or len(x) < 2 or len(centroids) < 2:
        return 10.0
    gap = np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))
    gap -= gap.min(axis=1, keepdims=True)
    needed = []
    for at in range(0, min(JUDGED, len(x)), 250):
        mine = np.arange(at, min(at + 250, JUDGED, len(x)))
        sims = x[mine] @ x.T
        sims[np.arange(len(mine)), mine] = -np.inf
        near = np.argpartition(-sims, min(rank, len(x) - 1) - 1, axis=1)[:, :rank]
        needed.append(np.maximum(gap[mine][:, None], gap[near]).min(axis=2).ravel())
    wanted = float(np.quantile(np.concatenate(needed), meeting))
    return min(wanted, float(np.quantile(gap, min(1.0, most_copies / len(centroids))))) + 1e-9


def fit(sample: np.ndarray, n_blocks: int, rank: int = 1, meeting: float = MEETING, most_copies: float = MOST_COPIES, list_rows: int = LIST_ROWS, rounds: int = 2, seed: int = 7, energy: float = 0.995, book_rows: int = SAMPLE_ROWS) -> Model:
    """Fit block centroids and anisotropic codebooks on unit vectors; the codebooks need no more than ``book_rows`` of them."""
    x = sample.astype(np.float32)
    dim = x.shape[1]
    centroids = _kmeans(x, n_blocks, 12, seed, spherical=True)
    margin = _margin(x, centroids, rank, meeting, most_copies)
    x = x[:book_rows]
    lists = _kmeans(x, max(1, len(x) // list_rows), 4, seed, spherical=True)
    home = _nearest(x, lists, 0.0)[0]
    t2 = SCORE_THRESHOLD**2
    weight = max(1.0, (dim - 1) * t2 / (1 - t2))
    axes = _axes(x - lists[home], energy)
    parts = (x @ axes).reshape(len(x), -1, WIDTH)
    residual = parts - (lists @ axes)[home].reshape(parts.shape)
    books = np.stack([_kmeans(residual[:, j], CODES, 8, seed + j, spherical=False) for j in range(parts.shape[1])])
    for _ in range(rounds):
        codes = _codes(residual, parts, books, weight, 1)
        left = residual - books[np.arange(len(books)), codes]
        along = (left * parts).sum(-1)
        total = along.sum(1)
        for j in range(len(books)):
            rest = total - along[:, j]
            p, e = parts[:, j].astype(np.float64), residual[:, j].astype(np.float64)
            outer = np.eye(p.shape[1]) + (weight - 1) * p[:, :, None] * p[:, None, :]
            wanted = e + (weight - 1) * p * (rest + (e * p).sum(1))[:, None]
            for c in range(CODES):
                mine = codes[:, j] == c
                if mine.sum() >= p.shape[1]:
                    books[j, c] = np.linalg.solve(outer[mine].sum(0), wanted[mine].sum(0))
            along[:, j] = ((residual[:, j] - books[j, codes[:, j]]) * parts[:, j]).sum(1)
            total = rest + along[:, j]
    return Model(centroids, axes, books.astype(np.float32), weight, margin)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scan(tables: np.ndarray, lists: np.ndarray, pairs: np.ndarray, list_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (queries x n) as small integers, and the step and the zero of each query's scale.

    ``tables`` (subspaces x 16 x queries) and ``lists`` (lists x queries) hold scores,
    ``pairs`` (subspaces / 2 x n) two codes in one number each, ``list_of`` the list of each row.
    """
    n, many = pairs.shape[1], tables.shape[2]
    low, base = tables.min(axis=1, keepdims=True), lists.min(axis=0)
    room = (tables - low).max(axis=1).sum(axis=0) + (lists - base).max(axis=0)
    step = np.maximum(room, 1e-12) / (65_535 - len(tables) - 1)
    steps = np.rint((tables - low) / step).astype(np.uint16)
    both = (steps[0::2, :, None] + steps[1::2, None]).reshape(-1, CODES * CODES, many)
    first = np.rint((lists - base) / step).astype(np.uint16)
    sums, part = np.empty((many, n), dtype=np.uint16), np.empty((TILE_ROWS, many), dtype=np.uint16)
    for at in range(0, n, TILE_ROWS):  # a tile stays in the processor's cache
        tile = first.take(list_of[at : at + TILE_ROWS], axis=0)
        for table, codes in zip(both, pairs[:, at : at + TILE_ROWS]):
            tile += table.take(codes, axis=0, out=part[: len(tile)], mode="clip")
        sums[:, at : at + TILE_ROWS] = tile.T
    return sums, step, low.sum(axis=(0, 1)) + base


def best_rows(sums: np.ndarray, keep: int) -> np.ndarray:
    """Rows of the ``keep`` greatest sums of each query in order, of equal sums the smaller rows."""
    many, n = sums.shape
    if n <= keep:
        return np.broadcast_to(np.arange(n), (many, n))
    least = np.partition(sums, n - keep, axis=1)[:, n - keep, None]
    query, row = np.divmod(np.flatnonzero(sums >= least), n)
    tied = sums[query, row] == least[query, 0]
    # Rows follow the ids, so of those that tie with the last the first ones stay.
    above = np.bincount(query[~tied], minlength=many)
    ties = np.bincount(query[tied], minlength=many)
    nth = np.arange(tied.sum()) - np.repeat(np.cumsum(ties) - ties, ties)
    stays = ~tied
    stays[tied] = nth < np.repeat(keep - above, ties)
    return row[stays].reshape(many, keep)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round((a * b).sum(-1), 9)


def _settle(who: np.ndarray, sums: np.ndarray, least: np.ndarray, found: np.ndarray, sims: np.ndarray, more: int, exact) -> None:
    """Scores every row of the queries ``who`` whose sum reaches ``least``, the best ``more`` where more do.

    Whatever was found stays in the running; ``found`` and ``sims`` are changed in place.
    """
    many, width = sums.shape[1], found.shape[1]
    query, row = np.divmod(np.flatnonzero(sums[who] >= np.maximum(least[who], 0)[:, None]), many)
    counts = np.bincount(query, minlength=len(who))
    if (counts > more).any():
        crowd = np.flatnonzero(counts > more)
        calm = counts[query] <= more
        query = np.concatenate([query[calm], np.repeat(crowd, min(more, many))])
        row = np.concatenate([row[calm], best_rows(sums[who[crowd]], more).ravel()])
    pair = np.sort(np.concatenate([query * many + row, (np.arange(len(who))[:, None] * many + found[who]).ravel()]))
    query, row = np.divmod(pair[np.append(True, pair[1:] != pair[:-1])], many)
    score = exact(who[query], row)
    order = np.lexsort((row, -score, query))
    counts = np.bincount(query, minlength=len(who))
    first = order[(np.cumsum(counts) - counts)[:, None] + np.arange(width)]
    found[who], sims[who] = row[first], score[first]


def search_block(model: Model, ids: np.ndarray, x: np.ndarray, base: np.ndarray, asks: np.ndarray, k: int, probes: int, keep: int, more: int, list_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``k`` best rows of ``base`` for each row of ``asks``: queries, ids and similarities, a chunk at a time.

    ``x`` has double unit vectors. Queries that share a home list share the lists they
    scan, those nearest to any of them. ``keep`` candidates are scored exactly, and up
    to ``more`` where codes left out lie within ``DOUBT`` deviations of the last neighbour.
    """
    base = base[np.argsort(ids[base], kind="stable")]
    names, wanted, single = ids[base], x[base], x.astype(np.float32)
    indexed = single[base]
    n_lists = max(1, round(len(base) / list_rows))
    sample = indexed if len(base) <= 16 * n_lists else indexed[np.random.default_rng(0).choice(len(base), 16 * n_lists, replace=False)]
    centres = _kmeans(sample, n_lists, 4, 11, spherical=True)
    list_of = _nearest(indexed, centres, 0.0)[0]
    codes = np.concatenate([model.encode(indexed[at : at + 4096], centres, list_of[at : at + 4096]) for at in range(0, len(base), 4096)])
    pairs = (codes[:, 0::2] * CODES + codes[:, 1::2]).T.astype(np.intp)
    members = np.split(np.argsort(list_of, kind="stable"), np.cumsum(np.bincount(list_of, minlength=n_lists))[:-1])
    home = _nearest(single[asks], centres, 0.0)[0]
    asks = asks[np.argsort(home, kind="stable")]
    counts = np.bincount(home, minlength=n_lists)
    width, at = min(k, len(base)), 0
    for count in counts[counts > 0]:
        for begin in range(at, at + count, QUERY_CHUNK):
            mine = asks[begin : min(begin + QUERY_CHUNK, at + count)]
            q = single[mine]
            near = centres @ q.T
            rows = np.arange(len(base))
            if probes < n_lists:
                lists = np.argpartition(-near.max(axis=1), probes - 1)[:probes]
                rows = some if len(some := np.sort(np.concatenate([members[i] for i in lists]))) >= width else rows
            turned = (q @ model.axes).reshape(len(q), -1, WIDTH)
            tables = np.matmul(model.books, turned.transpose(1, 2, 0))
            sums, step, zero = scan(tables, near, pairs.take(rows, axis=1), list_of.take(rows))

            some = best_rows(sums, max(keep, width))
            exact = _exact(wanted[rows[some]], x[mine][:, None])
            best = np.argsort(-exact, axis=1, kind="stable")[:, :width]
            found, sims = np.take_along_axis(some, best, 1), np.take_along_axis(exact, best, 1)
            coded = np.take_along_axis(sums, some, 1) * step[:, None] + zero[:, None]
            error = exact - coded
            least = sims[:, -1] - error.mean() - DOUBT * error.std()
            open_ = np.flatnonzero(coded.min(axis=1) > least) if len(rows) > keep else np.zeros(0, dtype=np.int64)
            if open_.size:
                _settle(open_, sums, np.ceil((least - zero) / step), found, sims, more, lambda who, row: _exact(wanted[rows[row]], x[mine[who]]))
            found = rows[found]
            yield ids[mine], names[found], sims
        at += count


def _cleaner(dim: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.fill_null(pc.and_(pc.is_valid(batch.column(0)), pc.equal(pc.list_value_length(batch.column(1)), dim)), False)
            batch = batch.filter(known)
            x = _raw(batch) + np.float32(0)  # -0 becomes 0
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)  # a null value reads as NaN
            x = x[good]
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["id", "vec"])

    return clean


def usable_vectors(vectors: DataFrame, dim: int, id_col: str = "image_id", vec_col: str = "vec") -> DataFrame:
    """``id, vec``: one vector of ``dim`` finite values and a norm above 0 for each id.

    Null ids, null, short, long, zero, NaN and infinite vectors are left out; if an id has
    several vectors the greatest counts, so repeated rows count once.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    return rows.mapInArrow(_cleaner(dim), "id long, vec array<float>").groupBy("id").agg(F.max("vec").alias("vec"))


def _sizes(shared):
    """Counts the rows of every block, a batch at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.centroids), dtype=np.int64)
        for x in map(_raw, batches):
            if len(x):
                total += np.bincount(shared.value.blocks(_unit(x).astype(np.float32))[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["block", "n"])

    return count


def _raw(batch: pa.RecordBatch) -> np.ndarray:
    vectors = batch.column(1)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.float32)


#: What a vector is in a cell: part of the index, a query, or both.
BASE, ASK = 1, 2


def _sender(shared, parts: np.ndarray):
    """Sends every vector to its blocks; a block of p > 1 parts is a grid of p x p cells of an index part and a query part."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, ids = _raw(batch), batch.column(0).to_numpy()
            row, block = shared.value.blocks(_unit(raw).astype(np.float32))
            p = parts[block]
            own = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % p
            sent = [(row[p == 1], block[p == 1], 0, 0, BASE | ASK)]
            for many in np.unique(p[p > 1]):
                mine = np.flatnonzero(p == many)
                for other in range(many):
                    same = own[mine] == other
                    sent.append((row[mine[same]], block[mine[same]], other, other, BASE | ASK))
                    sent.append((row[mine[~same]], block[mine[~same]], own[mine[~same]], other, BASE))
                    sent.append((row[mine[~same]], block[mine[~same]], other, own[mine[~same]], ASK))
            names = [raw[i].tobytes() for i in range(len(raw))]
            for r, b, v, q, role in sent:
                if len(r):
                    cell = (b.astype(np.int64) << 40) + (np.asarray(v, dtype=np.int64) << 20) + q
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell), pa.array(np.full(len(r), role, dtype=np.int8)), pa.array(ids[r]), pa.array([names[i] for i in r], pa.binary())], names=["cell", "role", "id", "vec"]
                    )

    return send


def _searcher(shared, dim: int, k: int, probes: int, keep: int, more: int, list_rows: int):
    def search(table: pa.Table) -> pa.Table:
        role, ids = table.column("role").to_numpy(), table.column("id").to_numpy()
        x = _unit(np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dim))
        base, asks = np.flatnonzero(role & BASE), np.flatnonzero(role & ASK)
        done = list(search_block(shared.value, ids, x, base, asks, k, probes, keep, more, list_rows)) if len(base) and len(asks) else []
        queries, found, sims = ([d[i] for d in done] for i in range(3))
        offsets = pa.array(np.concatenate([[0], np.cumsum([m.shape[1] for m in found for _ in m])]).astype(np.int32))
        flat = lambda parts, kind: pa.array(np.concatenate([m.ravel() for m in parts]) if parts else np.zeros(0), kind)
        return pa.table({"query": flat(queries, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, flat(found, pa.int64())), "sims": pa.ListArray.from_arrays(offsets, flat(sims, pa.float64()))})

    return search


def nearest(vectors: DataFrame, k: int, dim: int = 64, id_col: str = "image_id", vec_col: str = "vec", block_rows: int = BLOCK_ROWS, meeting: float = MEETING, most_copies: float = MOST_COPIES, probes: int = PROBES, keep: int | None = None, more: int | None = None, list_rows: int = LIST_ROWS, split_rows: int = SPLIT_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For every usable vector its ``k`` most similar others: ``<id_col>, indices, similarities``.

    Similarity is the cosine in double precision rounded to 9 decimals; ties go to the
    smaller id, and a vector is not its own neighbour. Lists are shorter than ``k`` only if
    there are fewer vectors; a lone vector has an empty list, an empty table no rows.
    More ``meeting``, ``most_copies``, ``probes``, ``keep`` and ``more`` find more; with 1
    for the first and the number of vectors for the others the result is exact.
    """
    spark = vectors.sparkSession
    members = stage(usable_vectors(vectors, dim, id_col, vec_col).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}), "vectors")
    crowded = stage(members.groupBy("h1", "h2").agg(F.count("*").alias("many")).where(F.col("many") > k + 1).select("h1", "h2"), "crowded")
    leaders = members
    if crowded.count():
        # The filter on the rank limits each class before its shuffle, so a class of copies is no hot task.
        nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
        first = members.join(crowded, ["h1", "h2"], "left_semi").withColumn("nth", nth).where(F.col("nth") <= k + 1)
        leaders = stage(members.join(crowded, ["h1", "h2"], "left_anti").withColumn("nth", F.lit(0)).unionByName(first), "leaders")
    n = leaders.count()
    if not n:
        return spark.createDataFrame([], f"{id_col} long, indices array<long>, similarities array<double>")
    n_blocks = min(MAX_BLOCKS, max(1, round(n / block_rows)))
    drawn = leaders.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(max(sample_rows, min(MOST_SAMPLE, max(n // 8, 32 * n_blocks)))).select("vec").toPandas()
    rank = max(1, round(k * len(drawn) / n))
    shared = spark.sparkContext.broadcast(fit(_unit(np.stack(drawn["vec"].to_numpy())), n_blocks, rank, meeting, most_copies, list_rows, book_rows=sample_rows))
    sent = leaders.select("id", "vec")
    parts = np.ones(n_blocks, dtype=np.int64)
    for row in sent.mapInArrow(_sizes(shared), "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():  # at most MAX_BLOCKS rows
        parts[row["block"]] = max(1, -(-row["n"] // split_rows))
    cells = sent.mapInArrow(_sender(shared, parts), "cell long, role byte, id long, vec binary")
    search = _searcher(shared, dim, k + 1, probes, keep or KEEP * (k + 1), more or MORE * (k + 1), list_rows)
    found = cells.groupBy("cell").applyInArrow(search, "query long, ids array<long>, sims array<double>")

    # Per query a few short lists are merged; whoever was met in two blocks has the same similarity in both.
    pairs = F.arrays_zip(F.transform("sims", lambda s: -s).alias("s"), F.col("ids").alias("i"))
    merged = found.select("query", pairs.alias("p")).groupBy("query").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))), 1, k + 1).alias("p"))
    if leaders is not members:
        firsts = leaders.where("nth = 1").select(F.col("id").alias("query"), "h1", "h2")
        copied = members.select("id", "h1", "h2").join(leaders.select("id"), "id", "left_anti").join(firsts, ["h1", "h2"])
        merged = stage(merged, "lists")
        merged = merged.unionByName(copied.join(merged, "query").select(F.col("id").alias("query"), "p"))
    others = F.slice(F.filter("p", lambda x: x["i"] != F.col("query")), 1, k)
    return merged.select(F.col("query").alias(id_col), F.transform(others, lambda x: x["i"]).alias("indices"), F.transform(others, lambda x: -x["s"]).alias("similarities"))


def neighbour_pairs(lists: DataFrame, id_col: str = "image_id") -> DataFrame:
    """``image_id_a < image_id_b``: pairs of which at least one has the other in its list."""
    flat = lists.select(F.col(id_col).alias("a"), F.explode("indices").alias("b"))
    return flat.select(F.least("a", "b").alias("image_id_a"), F.greatest("a", "b").alias("image_id_b")).distinct()
