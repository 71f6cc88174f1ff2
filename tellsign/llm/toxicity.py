"""Toxicity scores from FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A document is the set of its hashed words, word pairs and skip-grams (pairs with one or two words
between them); tokens are runs of letters, digits and non-ASCII bytes, lower-cased.  FTRL-proximal keeps
a learning rate for each coordinate and sets most weights to exactly zero through its L1 term, so
the model that travels to the tasks is a short list of (feature, weight); its size is bounded by
the table of ``2**BITS`` coordinates.  It is trained on a bounded sample of labelled rows
(``TRAIN_ROWS``), within one task.  Scoring is one pass over the texts.

Nulls and ties: a null or empty text has no features and gets the score of the bias alone.
Rows with a null or unknown label are not learned from; without such rows the score is 0.5.
Repeated rows get equal scores.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.llm import common

BITS = 20
SKIPS = (1, 2, 3)
TRAIN_ROWS = 8000
EPOCHS = 5
ALPHA = 1.0
BETA = 1.0
L1 = 8.0
L2 = 0.0
CUT = 0.5

_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed features, row of each), for single words and for each distance of a pair."""
    starts, ends, counts = common.word_bounds(data, offsets, _OUTSIDE)
    words = common.hash_spans(data, starts, ends)
    rows = np.repeat(np.arange(len(counts)), counts)
    shift = np.uint64(64 - BITS)
    yield (words >> shift).astype(np.int32), rows
    for d in SKIPS:
        if len(words) > d:
            same = rows[:-d] == rows[d:]
            pairs = common.fold_words([words[:-d][same], words[d:][same] ^ np.uint64(d)])
            yield (pairs >> shift).astype(np.int32), rows[:-d][same]


def feature_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct features of each row."""
    found = [f for f in features(data, offsets)]
    keys = np.unique(np.concatenate([(r.astype(np.int64) << BITS) | f for f, r in found]))
    heads = np.searchsorted(keys, np.arange(len(offsets), dtype=np.int64) << BITS)
    low = (keys & ((1 << BITS) - 1)).astype(np.int32)
    return [low[a:b] for a, b in zip(heads[:-1], heads[1:])]


@dataclass
class ToxicityModel:
    index: np.ndarray  # features with a weight other than zero
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.index] = self.weights
        out = []
        for _, _, data, offsets in common.slices(texts):
            hits = []
            for index, rows in features(data, offsets):
                hit = np.flatnonzero(table[index])
                hits.append((rows[hit].astype(np.int64) << BITS) | index[hit])
            keys = np.unique(np.concatenate(hits))
            total = np.bincount(keys >> BITS, weights=table[keys & ((1 << BITS) - 1)], minlength=len(offsets) - 1)
            out.append(1 / (1 + np.exp(-(total + self.bias))))
        return np.concatenate(out) if out else np.zeros(0)


def train(rows: list[tuple[np.ndarray, int]]) -> ToxicityModel:
    """FTRL-proximal over the rows, in an order fixed by a seed."""
    bias_at = 1 << BITS
    z, n = np.zeros(bias_at + 1), np.zeros(bias_at + 1)

    def weights(zi: np.ndarray, ni: np.ndarray, at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias_at, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS if rows else 0):
        for k in rng.permutation(len(rows)):
            index, y = rows[k]
            at = np.append(index, bias_at)
            zi, ni = z[at], n[at]
            w = weights(zi, ni, at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    all_ = np.arange(bias_at + 1)
    w = weights(z, n, all_)
    index = np.flatnonzero(w[:-1])
    return ToxicityModel(index.astype(np.int32), w[index].astype(np.float32), float(w[-1]))


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in common.slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first),
                pa.array([s.tobytes() for s in feature_sets(data, offsets)], pa.binary()),
            ], names=["doc_id", "y", "features"])


def _train_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.doc_id)
    model = train([(np.frombuffer(r.features, np.int32), int(r.y)) for r in rows])
    yield pd.DataFrame({
        "index": [model.index.tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from at most ``rows`` labelled rows that are not held out."""
    sample = common.labelled_sample(docs, labels, "toxic", rows)
    sets = sample.select("doc_id", "text", "y").mapInArrow(_set_batches, "doc_id long, y int, features binary")
    got = sets.repartition(1).mapInPandas(_train_task, "index binary, weights binary, bias double").collect()
    if not got:
        return train([])
    return ToxicityModel(np.frombuffer(got[0][0], np.int32), np.frombuffer(got[0][1], np.float32), got[0][2])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())],
                names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
