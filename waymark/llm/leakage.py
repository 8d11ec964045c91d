"""Problem 8: evaluation texts that stand, whole or in passages, in a training corpus.

Every task sorts the suffixes of its shard of the corpus (a training suffix array over
words, to the depth a passage needs), binary-searches every suffix of every test item in
it, and extends the hits to their longest verbatim match. Nothing of the corpus is
shuffled; the test items, a fixed table whose size is checked, are broadcast in blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one shard; a longer text is a shard of its own.
SHARD_WORDS = 1_500_000
#: Characters of test items searched at a time.
ITEM_BLOCK_CHARS = 20_000_000
#: Hits expanded at a time.
HIT_BLOCK = 2_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC normalisation and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


class Probes:
    """Every suffix of the test items, cut to ``depth`` words, and where it comes from."""

    def __init__(self, ids: list[int], texts: list[str | None], depth: int):
        self.depth, self.ids = depth, np.array(ids, dtype=np.int64)
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        items = [[number(w, len(self.vocabulary) + 1) for w in words(t)] for t in texts]
        lengths = np.array([len(x) for x in items], dtype=np.int64)
        self.flat = np.array([w for x in items for w in [*x, 0]] + [0] * depth, dtype=np.int32)
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1].astype(np.int64) if len(items) else np.zeros(0, np.int64)
        long = np.flatnonzero(lengths >= depth)
        counts = lengths[long] - depth + 1
        item = np.repeat(long, counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        grams = self.flat[(self.begin[item] + at)[:, None] + np.arange(depth)]
        short = np.flatnonzero((lengths > 0) & (lengths < depth))
        tails = np.zeros((len(short), depth), dtype=np.int32)
        for row, i in enumerate(short):
            tails[row, : lengths[i]] = items[i]
        self.grams, inverse = np.unique(np.concatenate([grams, tails]), axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.owner = np.concatenate([item, short])[order]
        self.owner_at = np.concatenate([at, np.zeros(len(short), dtype=np.int64)])[order]
        self.owners_from = np.concatenate([[0], np.cumsum(np.bincount(inverse.ravel(), minlength=len(self.grams)))])
        self.width = (self.grams != 0).sum(axis=1)
        self.least = int(self.width.min()) if len(self.width) else depth + 1


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].ravel().astype(np.int64)


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the ``depth`` words that follow, by prefix doubling."""
    rank, known, ranks = ids.astype(np.int64), 1, {1: ids.astype(np.int64)}

    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        later = np.zeros_like(b)
        later[: len(b) - shift] = b[shift:]
        return _dense(a * (int(b.max()) + 1) + later)

    while known * 2 <= depth:
        rank = joined(rank, rank, known)
        known *= 2
        ranks[known] = rank
    rest = depth - known
    for size in sorted((s for s in ranks if s <= rest), reverse=True):
        if rest >= size:
            rank = joined(rank, ranks[size], known)
            known, rest = known + size, rest - size
    return starts[np.argsort(rank[starts], kind="stable")]


def _bound(ids: np.ndarray, array: np.ndarray, probes: np.ndarray, width: np.ndarray, upper: bool) -> np.ndarray:
    """First place in the suffix array not below (``upper``: above) each probe's first ``width`` words."""
    depth = probes.shape[1]
    matters = np.arange(depth) < width[:, None]
    low, high = np.zeros(len(probes), dtype=np.int64), np.full(len(probes), len(array), dtype=np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        there = ids[array[middle][:, None] + np.arange(depth)]
        sign = np.sign(there - probes[open_]) * matters[open_]
        first = (sign != 0).argmax(axis=1)
        order = sign[np.arange(len(open_)), first]
        below = order <= 0 if upper else order < 0
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
    return low


def _search(doc_ids: list[int], doc_words: list[np.ndarray], probes: Probes) -> Iterator[pa.RecordBatch]:
    depth = probes.depth
    lengths = np.array([len(w) + 1 for w in doc_words], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.zeros(begins[-1] + depth + 1, dtype=np.int32)
    for b, w in zip(begins, doc_words):
        ids[b : b + len(w)] = w
    # A match can only start where at least as many words in a row as the shortest probe occur in some item.
    ends = np.flatnonzero(ids == 0)
    run = ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))
    starts = np.flatnonzero(run >= probes.least)
    if not len(starts):
        return
    array = suffix_array(ids, starts, depth)
    low = _bound(ids, array, probes.grams, probes.width, upper=False)
    there = ids[array[np.minimum(low, len(array) - 1)][:, None] + np.arange(depth)]
    matters = np.arange(depth) < probes.width[:, None]
    hit = np.flatnonzero((low < len(array)) & ((there == probes.grams) | ~matters).all(axis=1))
    if not len(hit):
        return
    low, high = low[hit], _bound(ids, array, probes.grams[hit], probes.width[hit], upper=True)
    owners = np.diff(probes.owners_from)[hit]
    blocks = np.cumsum((high - low) * owners) // HIT_BLOCK
    for block in np.unique(blocks):
        at = np.flatnonzero(blocks == block)
        places = (high - low)[at]
        total = places * owners[at]
        probe = np.repeat(at, total)
        nth = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        place = array[low[probe] + nth // owners[probe]]
        owner = probes.owners_from[hit[probe]] + nth % owners[probe]
        item, item_at = probes.owner[owner], probes.owner_at[owner]
        there = probes.begin[item] + item_at
        # Only the left end of a match is kept and extended to the right.
        before = np.where(item_at > 0, probes.flat[np.maximum(there - 1, 0)], -1)
        left = before != np.where(place > 0, ids[np.maximum(place - 1, 0)], 0)
        place, item, item_at, there = place[left], item[left], item_at[left], there[left]
        n = probes.width[hit[probe[left]]].astype(np.int64)
        going = np.arange(len(place))
        while going.size:
            a, b = ids[np.minimum(place[going] + n[going], len(ids) - 1)], probes.flat[there[going] + n[going]]
            going = going[(a == b) & (a != 0)]
            n[going] += 1
        doc = np.searchsorted(begins, place, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(doc_ids, dtype=np.int64)[doc]), pa.array(probes.ids[item]), pa.array(place - begins[doc]), pa.array(item_at), pa.array(n)],
            names=["doc", "item", "doc_word", "item_word", "n_words"],
        )


def _searcher(shared, shard_words: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes: Probes = shared.value
        known = probes.vocabulary.get
        ids: list[int] = []
        texts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                if len(found) < probes.least:
                    continue
                ids.append(i)
                texts.append(np.fromiter((known(w, 0) for w in found), dtype=np.int32, count=len(found)))
                size += len(found)
                if size >= shard_words:
                    yield from _search(ids, texts, probes)
                    ids, texts, size = [], [], 0
        if ids:
            yield from _search(ids, texts, probes)

    return search


def leaked_passages(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", min_words: int = 12, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Longest verbatim word matches between the documents and the test items.

    Returns ``<doc_col>, <item_col>, doc_word, item_word, n_words``: one row for each
    match of at least ``min_words`` words (or of the whole item, if it is shorter) that
    can't be extended. Null, empty and wordless texts match nothing; a null id is left
    out; repeated rows repeat their matches; other columns are ignored.
    """
    spark = docs.sparkSession
    held = items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    chars = held.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // ITEM_BLOCK_CHARS))
    corpus = docs.select(F.col(doc_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    parts = []
    for block in range(blocks):
        rows = (held.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else held).toPandas().sort_values("id")
        shared = spark.sparkContext.broadcast(Probes(rows["id"].tolist(), rows["text"].tolist(), min_words))
        parts.append(corpus.mapInArrow(_searcher(shared, shard_words), "doc long, item long, doc_word long, item_word long, n_words long"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumnsRenamed({"doc": doc_col, "item": item_col})


def leaked_pairs(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", min_words: int = 12) -> DataFrame:
    """``<doc_col>, <item_col>``: every document with every item that leaked into it."""
    return leaked_passages(docs, items, doc_col, item_col, text_col, min_words).select(doc_col, item_col).distinct()


def leak_report(docs: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """Per document and item the number of matches and the longest, with its place."""
    found = leaked_passages(docs, items, min_words=min_words)
    longest = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_matches"), longest).select("doc_id", "item_id", "n_matches", F.col("m.n_words").alias("longest_words"), (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def without_leaks(docs: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """The documents no item leaked into; documents with a null id can't be told and stay."""
    hit = leaked_passages(docs, items, min_words=min_words).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")
