"""Problem 9: long exact spans that stand in more than one document.

Content-defined chunking: a gear rolling hash over the last 32 code points marks a
cut wherever it is the least of 44 neighbouring hashes. Cuts depend on nothing but the
text around them, so they survive insertions elsewhere, and every stretch of 120 code
points that two texts share holds at least one whole chunk of both (two disjoint
windows of 44 hashes fit into it). Chunks are deduplicated by digest; only where a
chunk's digest occurs in a second document are the 120-character windows around the
chunk compared. Chunk digests of 64 bits only nominate; windows are compared by 126 bits:
a polynomial modulo 2^64 and two modulo primes, which hold where text is periodic.

Both comparisons are aggregates that keep the least and the greatest document id of a
digest, never a group of rows, and their joins carry one row of the digest on one
side; a passage that stands in a third of all documents costs rows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.sources.staging import stage

#: Code points a gear hash of 32 bits remembers.
GEAR_SPAN = 32
#: Characters hashed at a time in a Python worker.
BLOCK_CHARS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Primes of two further digests and the bases of their polynomials.
PRIMES = ((np.uint64(2_147_483_647), np.uint64(1_103_515_245)), (np.uint64(2_147_483_629), np.uint64(1_664_525_013)))
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def window_width(min_chars: int) -> int:
    """Hashes of which the least is a cut, so that ``min_chars`` hold two such windows."""
    width = (min_chars - GEAR_SPAN + 1) // 2
    if width < 2:
        raise ValueError(f"min_chars must be at least {GEAR_SPAN + 3}")
    return width


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gear_hashes(points: np.ndarray) -> np.ndarray:
    """Gear hash ending at every position: h = 2 h + gear(c), modulo 2^32, by doubling."""
    h = _mix32(points)
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    covered = 1
    while covered * 2 <= width:
        x = np.minimum(x[:-covered], x[covered:])
        covered *= 2
    return np.minimum(x[: len(x) - (width - covered)], x[width - covered :]) if width > covered else x


def _prefixes(points: np.ndarray, prime: np.uint64, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all prefixes, each ``base`` times the one before plus a character, and the powers of ``base``.

    By doubling: a digest over 2 w characters is one over w shifted, plus the next; rows of
    the squares of the powers are never needed twice.
    """
    n = len(points)
    powers = np.ones(n + 1, dtype=np.uint64)
    known = 1
    if n:
        powers[1] = base
    while known < n:
        more = min(known, n - known)
        powers[known + 1 : known + 1 + more] = powers[1 : more + 1] * powers[known] % prime
        known += more
    sums = np.zeros(n + 1, dtype=np.uint64)
    sums[1:] = (_mix32(points).astype(np.uint64) + np.uint64(1)) % prime
    shift = 1
    while shift <= n:
        longer = sums.copy()
        longer[shift:] = (sums[shift:] + sums[:-shift] * powers[shift]) % prime
        sums, shift = longer, shift * 2
    return sums, powers


class Spans:
    """Digests of arbitrary spans of one block of text, from prefix sums modulo 2^64 and modulo primes."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.points, self.modular = points, {}
        powers = np.full(n + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        inverse = np.full(n + 1, _BASE_INVERSE, dtype=np.uint64)
        inverse[0] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(inverse, out=inverse)
        self.inverse = inverse
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix64(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * powers[:-1], out=self.sums[1:])

    def residues(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two more digests of 31 bits each in one number, by polynomials modulo primes."""
        both = np.zeros(len(start), dtype=np.uint64)
        for prime, base in PRIMES:
            if prime not in self.modular:
                self.modular[prime] = _prefixes(self.points, prime, base)
            sums, powers = self.modular[prime]
            value = (sums[end] + prime * prime - sums[start] * powers[end - start]) % prime
            both = (both << np.uint64(31)) | value
        return both.view(np.int64)

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        polynomial = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mix64(polynomial ^ ((end - start).astype(np.uint64) << np.uint64(40))).view(np.int64)


def chunk_spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the documents that lie end to end in ``points``.

    Returns document number, first position and end (exclusive) of every chunk; a chunk
    includes the 31 code points before its first cut, on which that cut depends.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(points) < GEAR_SPAN + width:
        return none, none, none
    order = np.uint64(0xFFFFFFFF) - np.arange(len(points), dtype=np.uint64)
    least = _sliding_min((gear_hashes(points).astype(np.uint64) << np.uint64(32)) | order, width)
    first, windows = starts + GEAR_SPAN - 1, ends - width + 1
    fits = np.flatnonzero(windows > first)
    if not len(fits):
        return none, none, none
    counts = (windows - first)[fits]
    doc = np.repeat(fits, counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[fits], counts)
    cut = (np.uint64(0xFFFFFFFF) - (least[at] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.ones(len(cut), dtype=bool)
    new[1:] = cut[1:] != cut[:-1]
    cut, doc = cut[new], doc[new]
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    return doc[pair], cut[pair] - (GEAR_SPAN - 1), cut[pair + 1] + 1


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _chunker(width: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                lengths = np.fromiter(map(len, texts[a:b]), dtype=np.int64, count=b - a)
                ends = np.cumsum(lengths)
                points = _points(texts[a:b])
                doc, start, end = chunk_spans(points, ends - lengths, ends, width)
                base = (ends - lengths)[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(Spans(points).digests(start, end)), pa.array(ids[a:b][doc]), pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))],
                    names=["digest", "id", "start", "end"],
                )

    return chunks


def _window_digester(length: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            spans = batch.column(2)
            for a, b in _blocks(texts):
                lengths = np.fromiter(map(len, texts[a:b]), dtype=np.int64, count=b - a)
                ends = np.cumsum(lengths)
                owned = spans.slice(a, b - a)
                doc = np.repeat(np.arange(b - a), owned.value_lengths().to_numpy(zero_copy_only=False))
                inner = owned.flatten()
                start = inner.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                end = inner.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                first, last = np.maximum(end - length, 0), np.minimum(start, lengths[doc] - length)
                keep = last >= first
                base = (ends - lengths)[doc]
                steps = np.zeros(ends[-1] + 1, dtype=np.int64)
                np.add.at(steps, (base + first)[keep], 1)
                np.add.at(steps, (base + last)[keep] + 1, -1)
                at = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                owner = np.searchsorted(ends, at, side="right")
                parts = Spans(_points(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts.digests(at, at + length)), pa.array(parts.residues(at, at + length)), pa.array(ids[a:b][owner]), pa.array((at - (ends - lengths)[owner]).astype(np.int32))],
                    names=["digest", "check", "id", "start"],
                )

    return windows


def _in_two(rows: DataFrame, label: str, *digest: str) -> DataFrame:
    """Rows of ``rows`` whose digest (one or more columns) occurs under more than one id.

    The rows are written once; the aggregate combines before its shuffle and the join's
    row side is an ordinary exchange, which adaptive execution splits where a digest is hot.
    """
    written = stage(rows.where("digest is not null and id is not null"), label)
    twice = written.groupBy(*digest).agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low < _high").select(*digest)
    return written.join(twice, list(digest), "left_semi")


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 120) -> DataFrame:
    """Maximal runs of characters that lie in a shared stretch of ``min_chars``.

    Returns ``<id_col>, span_start, span_end`` (code points, end exclusive). Texts are
    compared as they are. Null, empty and shorter texts have no spans; rows that repeat
    one id count as that one document if their texts are equal; text repeated only
    within one document is not shared; other columns of ``docs`` are ignored.
    """
    width = window_width(min_chars)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.char_length("text") >= min_chars))
    chunks = texts.mapInArrow(_chunker(width), "digest long, id long, start int, end int")
    candidates = _in_two(chunks, "chunks", "digest").groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    windows = texts.join(candidates, "id").select("id", "text", "spans").mapInArrow(_window_digester(min_chars), "digest long, check long, id long, start int")
    order = Window.partitionBy("id").orderBy("start")
    opens: Column = F.coalesce((F.col("start") > F.lag("start").over(order) + min_chars).cast("int"), F.lit(0))
    runs = _in_two(windows, "windows", "digest", "check").select("id", "start").withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    return runs.groupBy("id", "run").agg(F.min("start").cast("long").alias("span_start"), (F.max("start") + min_chars).cast("long").alias("span_end")).select(F.col("id").alias(id_col), "span_start", "span_end")


def shared_shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 120) -> DataFrame:
    """For every document its length, shared characters and their share.

    Documents without shared text, null and empty ones included, have 0; a null id is left out.
    """
    spans = shared_spans(docs, id_col, text_col, min_chars)
    shared = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    sizes = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.coalesce(F.max(F.char_length(text_col)), F.lit(0)).cast("long").alias("n_chars"))
    return sizes.join(shared, id_col, "left").select(
        id_col, "n_chars",
        F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"),
    )
