"""Ranked lexical search of every benchmark item over all documents, by hashed max-sketches.

The impact of a term in a document is its weight times its saturated count, in whole numbers (``saturated``).  A document's
impacts fold into a sketch: coordinate ``hash(term) mod SKETCH`` holds the greatest impact of the terms that fall there.
The sum of a query's coordinates is then never below its score.  Documents come in slices; the sketches of a
slice are looked up for all queries at once, which gives a bound for each document and query.  Each query rescores its
documents exactly in descending order of their bounds, until the bound falls below the score of its ``k``-th best
so far.  A task keeps the ``k`` best of its own documents, and the best of all tasks are ranked by Spark.
That is exact: a document that is not rescored has ``k`` documents before it in its task already.

Only impacts of terms that some query asks for are folded, as the others can never count.  The queries with
their weights go to the tasks in parts of about ``PART_TERMS`` terms (24 bytes each), whatever the size of the benchmark; each
part counts its terms in all documents and searches them once.  Sketches and bounds live for one slice, so
memory does not depend on the number of documents, nor on how many of them share a term.

Terms are compared by 64-bit hashes: a document's term counts for a query's other term with a chance below
(terms of the queries) * (terms of all documents) / 2**64.

Nulls and ties: a null or wordless text has no terms, matches nothing and does not count as a document; each
repeated row of the documents is ranked for itself, one without id after those with equal score; benchmark rows that are
equal in id and text are one item, others are items of their own, also if ids repeat or are null.  Items without
a matching document have no rows.  Empty tables give an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellsign.llm import common
from tellsign.llm.common import stored

BEST = 10
SKETCH = 1024
STEP = 16
PART_TERMS = 1 << 20
LOOKUP_TERMS = 1 << 12
SLICE_ROWS = 512
NO_ID = np.int64(2**63 - 1)

# Bytes that part terms: ASCII but letters and digits.
_OUTSIDE = np.zeros(256, dtype=bool)
_OUTSIDE[:128] = True
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _OUTSIDE[_low:_high] = False


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of bounded bytes and rows."""
    for at in range(0, len(texts), SLICE_ROWS):
        for first, end, data, offsets in common.slices(texts.slice(at, SLICE_ROWS)):
            yield at + first, at + end, data, offsets


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a slice in order, and the number of terms of each row."""
    starts, ends, counts = common.word_bounds(data, offsets, _OUTSIDE)
    return common.hash_spans(data, starts, ends), counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in _slices(batch.column(1)):
            terms, counts = terms_of(data, offsets)
            row = np.repeat(np.arange(len(counts)), counts)
            own = np.unique(np.rec.fromarrays([row, terms]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(first + own["f0"])), pa.array(own["f1"].view(np.int64))],
                names=["item", "term"])


def query_terms(items: DataFrame) -> DataFrame:
    """``item, term``: the distinct term hashes of each row of ``items`` (``item, text``)."""
    return items.select("item", "text").mapInArrow(_item_terms, "item long, term long")


@dataclass
class Queries:
    """Queries of one part: ``terms[of[first[q]:first[q + 1]]]`` are the terms of the ``q``-th."""

    item: np.ndarray
    first: np.ndarray
    of: np.ndarray
    terms: np.ndarray

    @classmethod
    def collect(cls, rows: DataFrame) -> Queries:
        got = rows.toArrow()
        item, term = got["item"].to_numpy(), got["term"].to_numpy().view(np.uint64)
        order = np.lexsort((term, item))
        names, first = np.unique(item[order], return_index=True)
        terms, of = np.unique(term[order], return_inverse=True)
        return cls(names, np.append(first, len(item)), of, terms)

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms of a query, and the numbers of these terms."""
        if not len(self.terms):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == hashes)
        return hit, at[hit]


def _counts(queries: Queries) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of each query term; in the row without a term all documents with terms, and all terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.terms), dtype=np.int64)
        documents = words = 0
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column(1)):
                hashes, counts = terms_of(data, offsets)
                documents += int((counts > 0).sum())
                words += len(hashes)
                hit, term = queries.found(hashes)
                row = np.searchsorted(np.cumsum(counts), hit, "right")
                df += np.bincount(np.unique(row * len(df) + term) % max(len(df), 1), minlength=len(df))
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *queries.terms[own].view(np.int64).tolist()], pa.int64()),
             pa.array(np.append(documents, df[own])), pa.array(np.append(words, np.zeros(len(own), np.int64)))],
            names=["term", "documents", "words"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    m = 10 + (90 * n * documents) // words
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Best:
    """The best documents of each query so far, in order."""

    def __init__(self, queries: int, k: int):
        self.score = np.zeros((queries, k), dtype=np.int64)
        self.doc = np.full((queries, k), NO_ID)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """One row of ``score`` and ``doc`` for each query of ``q``; scores of 0 do not count."""
        score = np.concatenate([self.score[q], score], axis=1)
        doc = np.concatenate([self.doc[q], doc], axis=1)
        order = np.lexsort((doc, -score), axis=1)[:, :self.score.shape[1]]
        self.score[q] = np.take_along_axis(score, order, axis=1)
        self.doc[q] = np.take_along_axis(doc, order, axis=1)


class _Slice:
    """Impacts of the query terms in the documents of a slice."""

    def __init__(self, queries: Queries, weights: np.ndarray, coordinate: np.ndarray, hashes: np.ndarray,
                 counts: np.ndarray, documents: int, words: int):
        self.queries, self.rows, self.vocabulary = queries, len(counts), len(queries.terms)
        self.coordinate = coordinate
        hit, term = queries.found(hashes)
        row = np.searchsorted(np.cumsum(counts), hit, "right")
        self.key, tf = np.unique(row * self.vocabulary + term, return_counts=True)
        row, term = self.key // max(self.vocabulary, 1), self.key % max(self.vocabulary, 1)
        self.impact = weights[term] * saturated(tf, counts[row], documents, words) if len(tf) else tf
        self.sketch = np.zeros((SKETCH, self.rows), dtype=np.int64)
        np.maximum.at(self.sketch, (coordinate[term], row), self.impact)

    def bounds(self, q0: int, q1: int) -> np.ndarray:
        """One row for each of these queries, one column for each document."""
        first = self.queries.first[q0:q1 + 1]
        asked = self.queries.of[first[0]:first[-1]]
        return np.add.reduceat(self.sketch[self.coordinate[asked]], first[:-1] - first[0], axis=0)

    def exact(self, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a document."""
        size = self.queries.first[q + 1] - self.queries.first[q]
        upto = np.cumsum(size)
        at = np.arange(upto[-1]) + np.repeat(self.queries.first[q] - (upto - size), size)
        want = np.repeat(row, size) * self.vocabulary + self.queries.of[at]
        place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        found = np.where(self.key[place] == want, self.impact[place], 0)
        return np.add.reduceat(found, upto - size)


def _rescore(part: _Slice, best: _Best, docs: np.ndarray, q0: int, q1: int, bounds: np.ndarray) -> int:
    """Descending bounds, ``STEP`` documents of each query at a time; the number of pairs that were rescored."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    active, done = np.arange(q0, q1), 0
    for at in range(0, part.rows, STEP):
        rows = order[active - q0, at:at + STEP]
        bound = bounds[(active - q0)[:, None], rows]
        live = (bound > 0) & (bound >= best.least()[active][:, None])
        going = live.any(axis=1)
        active, rows, live = active[going], rows[going], live[going]
        if not len(active):
            break
        which, column = np.nonzero(live)
        score = np.zeros(rows.shape, dtype=np.int64)
        score[which, column] = part.exact(active[which], rows[which, column])
        done += len(which)
        best.add(active, score, np.where(score > 0, docs[rows], NO_ID))
    return done


def _search(queries: Queries, weights: np.ndarray, documents: int, words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries.item), k)
        coordinate = (queries.terms % np.uint64(SKETCH)).astype(np.int64)
        # blocks of queries that look up a bounded number of coordinates
        ends = np.searchsorted(queries.first, np.arange(0, queries.first[-1], LOOKUP_TERMS)) if len(queries.item) else []
        blocks = np.unique(np.append(ends, len(queries.item)))
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy()
            for first, end, data, offsets in _slices(batch.column(1)):
                hashes, counts = terms_of(data, offsets)
                part = _Slice(queries, weights, coordinate, hashes, counts, documents, words)
                for q0, q1 in zip(blocks[:-1], blocks[1:]):
                    if len(part.key):
                        _rescore(part, best, ids[first:end], q0, q1, part.bounds(q0, q1))
        q, place = np.nonzero(best.score)
        doc = best.doc[q, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries.item[q]), pa.array(doc, mask=doc == NO_ID), pa.array(best.score[q, place])],
            names=["item", "doc_id", "score"])

    return run


def best_documents(docs: DataFrame, items: DataFrame, k: int = BEST, part_terms: int = PART_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item (``item_id, text``)."""
    own = stored(items.select("item_id", "text").dropDuplicates().withColumn(
        "item", F.monotonically_increasing_id()), "items")
    asked = stored(query_terms(own), "item-terms")
    parts = max(1, -(-asked.count() // part_terms))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = None
    for i in range(parts):
        queries = Queries.collect(asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i))
        counted = texts.mapInArrow(_counts(queries), "term long, documents long, words long").groupBy("term").agg(
            F.sum("documents").alias("documents"), F.sum("words").alias("words")).toArrow().to_pylist()
        total = next((r for r in counted if r["term"] is None), {"documents": 0, "words": 0})
        df = {r["term"]: r["documents"] for r in counted}
        weights = np.array([weight(total["documents"], df.get(t, 0)) for t in queries.terms.view(np.int64).tolist()], dtype=np.int64)
        local = texts.mapInArrow(
            _search(queries, weights, total["documents"], total["words"], k), "item long, doc_id long, score long")
        found = local if found is None else found.unionByName(stored(local, "ranked"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
