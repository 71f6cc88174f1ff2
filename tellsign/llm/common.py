"""Shared helpers: stored tables, word hashes of whole Arrow batches, held-out rule.

A word is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``; lower-casing
touches A-Z only.  Hashes are 64 bits wide.  They are computed for a whole batch at once from
the bytes of the Arrow column, in slices of bounded size (a longer single text is one slice).
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.session import scratch_dir

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 19
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and reread it.

    That cuts the lineage with a table all executors can reach, so a lost executor costs at
    most the tasks it was running.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _GOLDEN)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = random_words(256, 1)
_BYTE_LOW = _BYTE[_LOWER]
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), np.uint64(0x2545F4914F6CDD1D))
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def slices(
    texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and of the end) of each slice of ``most`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, places, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(places, dtype=width)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, int(offsets[row]) + most, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, raw[offsets[row]:offsets[end]], offsets[row:end + 1].astype(np.int64) - offsets[row]
        row = end


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a slice, and the number of words of each row.

    ``outside`` marks the bytes that part words.
    """
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(outside[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    first = edges[edges < len(data)]
    begins[first] = inside[1:-1][first]
    last = edges[edges > 0] - 1
    stops[last] = inside[1:-1][last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.diff(np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of the bytes of each (disjoint, ascending, not empty) span."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    heads = np.zeros(len(sizes), dtype=np.int64)
    np.cumsum(sizes[:-1], out=heads[1:])
    within = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(heads, sizes)
    bytes_ = data[within + np.repeat(starts, sizes)]
    values = (_BYTE_LOW if lower else _BYTE)[bytes_] * _powers(int(sizes.max()))[within]
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(values, heads) + sizes.astype(np.uint64) * _GOLDEN)


def fold_words(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Hash of word sequences; ``parts`` holds the first words, the second words and so on."""
    out, n = None, 0
    with np.errstate(over="ignore"):
        for p in parts:
            out = p if out is None else mix(out) * _FOLD + p
            n += 1
        return mix(out + np.uint64(n) * _GOLDEN)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice in order, and the number of words of each row."""
    starts, ends, counts = word_bounds(data, offsets)
    return hash_spans(data, starts, ends, lower), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``rows`` labelled documents that are not held out.

    The rows with the least hash of the id are taken, so reruns agree.  At most ``rows`` ids are
    broadcast; an id counts once, however often it occurs (with its greatest label and text).
    """
    order = F.xxhash64("doc_id")
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(
        order, "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.max("text").alias("text"), F.max("y").alias("y"))


def ngrams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a row, and their number for each row."""
    each = np.maximum(counts - n + 1, 0)
    if not each.sum():
        return np.zeros(0, dtype=np.uint64), each
    total = len(words) - n + 1
    runs = fold_words(words[j:total + j] for j in range(n))
    heads = np.cumsum(counts) - counts
    keep = np.repeat(heads, each) + (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))
    return runs[keep], each


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row.

    A row with fewer than ``k`` words has one shingle, its whole word sequence; without words
    it has none.
    """
    words, counts = words_of(data, offsets)
    runs, each = ngrams(words, counts, k)
    heads, run_heads = np.cumsum(counts) - counts, np.cumsum(each) - each
    out = []
    for i, n in enumerate(counts):
        if n >= k:
            out.append(np.unique(runs[run_heads[i]:run_heads[i] + each[i]]))
        elif n:
            own = words[heads[i]:heads[i] + n]
            out.append(fold_words(own[j:j + 1] for j in range(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
