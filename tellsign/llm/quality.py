"""Quality scores from supervised subword embeddings.

A document is the average of learned vectors of its words and of the character n-grams inside
its words (word boundaries count as a character), all hashed into fixed tables; a softmax layer
over that average gives the two classes.  Vectors and layer are learned together by plain
stochastic gradient descent in numpy, on a bounded sample of labelled rows (``TRAIN_ROWS``),
within one task that is simply run again if its executor is lost.

Since the layer is linear, the score of a document is the average of one number for each
hashed feature (its vector times the difference of the two output rows), so scoring looks up
scalars: a broadcast table of fixed size (``2**BITS`` floats) and one pass over the texts.

Nulls and ties: a null or empty text has no features and gets the score of the bias alone.
Rows with a null or unknown label are not learned from; without rows of both classes the score is
the smoothed share of label 1.  Repeated rows get equal scores.
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

BITS = 18
DIMENSIONS = 8
GRAMS = (3, 4)
TRAIN_ROWS = 4000
EPOCHS = 8
RATE = 2.0
CUT = 0.3

_TEXT = np.arange(256, dtype=np.uint32)
_TEXT[common.SPACE] = 32


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (x ^ (x >> np.uint32(15))) & np.uint32((1 << BITS) - 1)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed features, number of them before each row and in all), for words and each n-gram size."""
    words, counts = common.words_of(data, offsets, lower=False)
    yield (words >> np.uint64(64 - BITS)).astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])
    chars = _TEXT[data]
    inner = ~common.SPACE[data]
    for n in GRAMS:
        total = len(data) - n + 1
        if total <= 0:
            yield np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
            continue
        gram = np.full(total, np.uint32(2166136261 + n))
        whole = np.ones(total, dtype=bool)
        for j in range(n):
            gram = (gram ^ chars[j:total + j]) * np.uint32(16777619)
            if 0 < j < n - 1:
                whole &= inner[j:total + j]
        for edge in offsets[1:-1]:
            whole[max(edge - n + 1, 0):edge] = False
        kept = np.concatenate([[0], np.cumsum(whole)])
        yield _scatter(gram[whole]), kept[np.minimum(offsets, total)]


def bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, their shares) of each row."""
    parts = list(features(data, offsets))
    for i in range(len(offsets) - 1):
        own = np.concatenate([f[h[i]:h[i + 1]] for f, h in parts])
        index, n = np.unique(own, return_counts=True)
        yield index, (n / max(len(own), 1)).astype(np.float32)


@dataclass
class QualityModel:
    weights: np.ndarray  # one number for each feature
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offsets in common.slices(texts):
            total = np.zeros(len(offsets) - 1)
            n = np.zeros(len(offsets) - 1)
            for index, heads in features(data, offsets):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
                total += sums[heads[1:]] - sums[heads[:-1]]
                n += np.diff(heads)
            out.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias))))
        return np.concatenate(out) if out else np.zeros(0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> QualityModel:
    """Vectors and softmax layer by stochastic gradient descent, the rate falling to zero."""
    ones = sum(y for _, _, y in rows)
    if ones in (0, len(rows)):
        share = (ones + 1) / (len(rows) + 2)
        return QualityModel(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            index, share, y = rows[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            if not len(index):
                continue
            mean = share @ vectors[index]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= rate * np.float32(0.05) * p
            vectors[index] -= rate * share[:, None] * back[None, :]
    return QualityModel(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in common.slices(batch.column(1)):
            pairs = list(bags(data, offsets))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first),
                pa.array([i.astype(np.int32).tobytes() for i, _ in pairs], pa.binary()),
                pa.array([s.tobytes() for _, s in pairs], pa.binary()),
            ], names=["doc_id", "y", "features", "shares"])


def _train_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [r for f in frames for r in f.itertuples(index=False)]
    rows.sort(key=lambda r: r.doc_id)
    model = train([(np.frombuffer(r.features, np.int32), np.frombuffer(r.shares, np.float32), int(r.y))
                   for r in rows])
    yield pd.DataFrame({"weights": [model.weights.astype(np.float32).tobytes()], "bias": [model.bias]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Learn from at most ``rows`` labelled rows that are not held out."""
    sample = common.labelled_sample(docs, labels, "quality", rows)
    bagged = sample.select("doc_id", "text", "y").mapInArrow(
        _bag_batches, "doc_id long, y int, features binary, shares binary")
    got = bagged.repartition(1).mapInPandas(_train_task, "weights binary, bias double").collect()
    if not got:
        return train([])
    return QualityModel(np.frombuffer(got[0][0], np.float32), got[0][1])


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())],
                names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """The rows with a score of at least ``cut``, with all columns.  No row is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
