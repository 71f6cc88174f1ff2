"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is found in a document when at least ``threshold`` of its distinct five-word shingles
occur in the document.  A short item in a long document has a tiny Jaccard similarity with it,
so the search is partitioned by size on both sides:

* Items are dealt to size classes, class ``c`` holding up to ``2**c`` shingles.
* For each class a document is read as overlapping windows of ``2 * 2**c`` shingles with step
  ``2**c``; each run of up to ``2**c`` shingles lies whole in one window.  The window's size is
  bounded, so the containment threshold becomes a bound on the Jaccard similarity, at
  worst ``.4 / (2 + .5 - .4) > .19`` for a threshold of 0.8.
* Window and item are candidates when one of 64 minima of universal hashes is equal (one row
  in each band).  At that bound the chance to miss is ``(1 - .19)**64 < 2e-6``.

The window minima of all classes come from one evaluation of each hash function, blocks of the
smaller class being joined to those of the next.  Each candidate is then decided by exact
containment in the whole document, within the same task, so no text is shuffled.

The items travel to the tasks in parts of at most ``ITEMS`` items and ``ITEM_SHINGLES`` shingles
(one larger item makes a part of its own); a larger benchmark takes more passes over the documents.

Nulls and ties: a null text is an empty one and contains nothing; an item without words is
found nowhere.  An item of fewer than five words is found where its whole word sequence occurs
in one run.  Each document row gives its own result rows, each distinct item row is an item, and
items without an id take no part.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.llm import common
from tellsign.llm.common import SHINGLE_WORDS, stored

HASHES = 64
LEAST_CLASS = 4
THRESHOLD = 0.8
ITEMS = 20_000
ITEM_SHINGLES = 1_000_000
FILTER_BITS = 22

_MULTIPLY = common.random_words(HASHES, 21) | np.uint64(1)
_ADD = common.random_words(HASHES, 22)
FOUND = "doc_id long, item_id long, item_shingles long, shared long"


def size_class(n: int) -> int:
    return max(LEAST_CLASS, int(n - 1).bit_length())


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in common.slices(batch.column(1)):
            counts = common.words_of(data, offsets)[1]
            sets = common.shingles(data, offsets)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, end - first),
                pa.array(np.minimum(counts, SHINGLE_WORDS), pa.int32()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], names=["item_id", "words", "shingles"])


class ItemIndex:
    """The items of one part: their sets, and by class and hash the minima to look for."""

    def __init__(self, rows: list[tuple[int, int, list[int]]], threshold: float):
        self.threshold = threshold
        self.items = [r[0] for r in rows]
        self.words = np.array([r[1] for r in rows], dtype=np.int64)
        self.sets = [np.sort(np.array(r[2], dtype=np.int64).view(np.uint64)) for r in rows]
        full = [i for i, w in enumerate(self.words) if w == SHINGLE_WORDS]
        self.short = sorted({int(w) for w in self.words if w < SHINGLE_WORDS})
        self.short_of: dict[tuple[int, int], list[int]] = {}
        for i, w in enumerate(self.words):
            if w < SHINGLE_WORDS:
                self.short_of.setdefault((int(w), int(self.sets[i][0])), []).append(i)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for c in sorted({size_class(len(self.sets[i])) for i in full}):
            own = [i for i in full if size_class(len(self.sets[i])) == c]
            keys = np.concatenate([self._keys(i) for i in own])
            order = np.argsort(keys, kind="stable")
            wanted = np.zeros(1 << FILTER_BITS, dtype=bool)
            wanted[keys & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.classes[c] = keys[order], np.repeat(own, HASHES)[order], wanted

    def _keys(self, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            least = (self.sets[i][None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1)
        return tag(least, np.arange(HASHES))


def tag(minima: np.ndarray, j: np.ndarray | int) -> np.ndarray:
    """A minimum together with the number of its hash function."""
    with np.errstate(over="ignore"):
        return common.mix(minima ^ (np.asarray(j, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _window_hits(runs: np.ndarray, each: np.ndarray, index: ItemIndex) -> set[tuple[int, int]]:
    """(row of the slice, item) where a window of the row and the item share a minimum."""
    found: set[tuple[int, int]] = set()
    rows = np.flatnonzero(each)
    if not len(rows) or not index.classes:
        return found
    low, high = min(index.classes), max(index.classes)
    step = 1 << low
    blocks = -(-each[rows] // step)
    place = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat((np.cumsum(each) - each)[rows], blocks) + place * step
    owner = np.repeat(rows, blocks)
    # how blocks of one class join to those of the next, and which blocks follow one another
    layout, own, at = {}, owner, place
    for c in range(low, high + 1):
        follows = np.flatnonzero((own[1:] == own[:-1])) if len(own) > 1 else np.zeros(0, np.int64)
        heads = np.flatnonzero(at % 2 == 0)
        layout[c] = own, follows, heads
        own, at = own[heads], at[heads] // 2
    hashed = np.empty_like(runs)
    mask = np.uint64((1 << FILTER_BITS) - 1)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            np.multiply(runs, _MULTIPLY[j], out=hashed)
            np.add(hashed, _ADD[j], out=hashed)
            least = np.minimum.reduceat(hashed, starts)
            for c in range(low, high + 1):
                own, follows, heads = layout[c]
                if c in index.classes:
                    keys, items, wanted = index.classes[c]
                    window = least.copy()
                    window[follows] = np.minimum(least[follows], least[follows + 1])
                    window = tag(window, j)
                    hit = np.flatnonzero(wanted[window & mask])
                    lo, hi = np.searchsorted(keys, window[hit], "left"), np.searchsorted(keys, window[hit], "right")
                    for k in np.flatnonzero(hi > lo):
                        found.update((int(own[hit[k]]), int(i)) for i in items[lo[k]:hi[k]])
                if c < high:
                    least = np.minimum.reduceat(least, heads)
    return found


def _hits(texts: pa.Array, index: ItemIndex) -> Iterator[tuple[int, int, int]]:
    """(row, number of the item, shingles shared) of all items found in a batch of texts."""
    for first, _, data, offsets in common.slices(texts):
        words, counts = common.words_of(data, offsets)
        runs, each = common.ngrams(words, counts, SHINGLE_WORDS)
        heads = np.cumsum(each) - each
        by_row: dict[int, list[int]] = {}
        for row, item in _window_hits(runs, each, index):
            by_row.setdefault(row, []).append(item)
        for row, items in by_row.items():
            own = np.unique(runs[heads[row]:heads[row] + each[row]])
            for i in items:
                shared = len(np.intersect1d(own, index.sets[i], assume_unique=True))
                if shared >= index.threshold * len(index.sets[i]):
                    yield first + row, i, shared
        for n in index.short:
            wanted = np.array([h for w, h in index.short_of if w == n], dtype=np.uint64)
            grams, per = common.ngrams(words, counts, n)
            hit = np.flatnonzero(np.isin(grams, wanted))
            rows = np.repeat(np.arange(len(per)), per)[hit]
            for row, gram in sorted(set(zip(rows.tolist(), grams[hit].tolist()))):
                for i in index.short_of[n, gram]:
                    yield first + row, i, 1


def _search(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = sorted(_hits(batch.column(1), index))
        if hits:
            rows, items, shared = (list(x) for x in zip(*hits))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array([index.items[i] for i in items], pa.int64()),
                pa.array([len(index.sets[i]) for i in items], pa.int64()), pa.array(shared, pa.int64()),
            ], names=["doc_id", "item_id", "item_shingles", "shared"])


def _clean(batches: Iterator[pa.RecordBatch], index: ItemIndex, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        keep[[row for row, _, _ in _hits(batch.column(text), index)]] = False
        yield batch.filter(pa.array(keep))


def indexes(items: DataFrame, threshold: float) -> list[Broadcast]:
    """The parts of the benchmark, each of a bounded size, ready for the tasks."""
    spark = items.sparkSession
    sets = stored(items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(
        _item_sets, "item_id long, words int, shingles array<long>").where("size(shingles) > 0").distinct(), "items")
    n, total = sets.agg(F.count(F.lit(1)), F.sum(F.size("shingles"))).first()
    parts = max(-(-n // (ITEMS // 2)), -(-(total or 0) // (ITEM_SHINGLES // 2)), 1)
    return [spark.sparkContext.broadcast(ItemIndex(
        [tuple(r) for r in sets.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()],
        threshold)) for part in range(parts)]


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, item_shingles, shared, containment`` of all items found in documents."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [text.mapInArrow(lambda it, index=index: _search(it, index.value), FOUND)
             for index in indexes(items, threshold)]
    return reduce(DataFrame.unionByName, parts).withColumn(
        "containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows in which no item is found, with all columns.  No row is shuffled."""
    at = docs.columns.index("text")
    for index in indexes(items, threshold):
        docs = docs.mapInArrow(lambda it, index=index: _clean(it, index.value, at), docs.schema)
    return docs


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_items(common.documents(spark, sf_dir), items)
