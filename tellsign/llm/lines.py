"""Removal of repeated passages by content-defined chunks of lines.

The lines of a text are hashed, and a rolling hash over the last ``WINDOW`` lines marks some lines as
boundaries.  A chunk starts at every line and ends at the first boundary after it that leaves it at least two
lines and ``LEAST_WORDS`` words, at the latest once it holds ``MOST_WORDS`` words or ``MOST_LINES`` lines.  So
a chunk depends on its own lines only, wherever they stand, and any repeated run of two or more lines and ``MOST_WORDS``
words holds a repeated chunk.  A line of ``MOST_WORDS`` words or more is a chunk alone.  Chunks that occur more than
once over all documents are removed but for their first occurrence (by id, then place); chunks overlap, and
their union goes.  Whatever lines go stay once in the corpus.

Chunks are first counted by hash, which moves narrow rows pre-aggregated by task.  Only the texts of
chunks whose hash repeats are cut out and compared: equal bytes, grouped by Spark, are what makes a repeat.
A chunk in a third of all documents is one row for each task.

Nulls and ties: a null text is an empty one and has no chunks; rows without an id come after those with one.
Rows with equal id and text are one document: each gets the same result.  Places are bytes of the UTF-8 text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellsign.llm import common
from tellsign.llm.common import fresh, stored
from tellsign.llm.minhash import STAND_IN, node_id

WINDOW = 2
DIVISOR = 2
LEAST_LINES, MOST_LINES = 2, 64
LEAST_WORDS, MOST_WORDS = 10, 50
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def boundary_marks(lines: np.ndarray) -> np.ndarray:
    """Whether a rolling hash over the ``WINDOW`` lines that end here ends a chunk."""
    rolling = np.zeros(len(lines), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(WINDOW, len(lines))):
            rolling[j:] += lines[:len(lines) - j] * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        return common.mix(rolling) % np.uint64(DIVISOR) == 0


def chunk_ends(lines: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each line of a slice, the line after the chunk that starts there; 0 where none does.

    ``counts`` is the number of lines of each text.
    """
    n = len(lines)
    at, none = np.arange(n), np.int64(n)
    upto = np.cumsum(words)
    before = upto - words
    marks = np.append(np.where(boundary_marks(lines), at, none), none)
    next_mark = np.minimum.accumulate(marks[::-1])[::-1]
    long_line = words >= MOST_WORDS
    next_long = np.minimum.accumulate(np.where(long_line, at, none)[::-1])[::-1] if n else at
    # the line at which a chunk has words enough, the one at which it has too many
    enough = np.maximum(np.searchsorted(upto, before + LEAST_WORDS), at + LEAST_LINES - 1)
    full = np.maximum(np.searchsorted(upto, before + MOST_WORDS), at + LEAST_LINES - 1)
    last = np.minimum(np.repeat(np.cumsum(counts), counts), next_long) - 1
    stop = np.minimum.reduce([next_mark[np.minimum(enough, n)], full, at + MOST_LINES - 1, last])
    whole = (stop >= enough) & ~long_line
    return np.where(long_line, at + 1, np.where(whole, stop + 1, 0))


def chunk_hashes(lines: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the lines of the chunk that starts at each line."""
    out = np.zeros(len(lines), dtype=np.uint64)
    size = np.where(ends > 0, ends - np.arange(len(lines)), 0)
    with np.errstate(over="ignore"):
        for k in range(int(size.max()) if len(size) else 0):
            at = np.flatnonzero(size > k)
            out[at] = common.mix(out[at] + lines[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        return common.mix(out + size.astype(np.uint64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in common.slices(batch.column(2)):
            starts, ends, counts = common.word_bounds(data, offsets, _NEWLINE)
            hashes = common.hash_spans(data, starts, ends, lower=False)
            word_starts = common.word_bounds(data, offsets)[0]
            words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
            until = chunk_ends(hashes, words, counts)
            own = np.flatnonzero(until)
            rows = np.repeat(np.arange(len(counts)), counts)[own]
            at = pa.array(first + rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 pa.array((starts[own] - offsets[rows]).astype(np.int32)),
                 pa.array((ends[until[own] - 1] - offsets[rows]).astype(np.int32)),
                 pa.array(chunk_hashes(hashes, until)[own].view(np.int64))],
                names=["nid", "mark", "start", "stop", "chunk"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        out = {"nid": [], "mark": [], "start": [], "stop": [], "bytes": []}
        for nid, mark, text, spans in zip(rows["nid"], rows["mark"], rows["text"], rows["spans"]):
            raw = text.encode()
            for s in spans:
                for k, v in (("nid", nid), ("mark", mark), ("start", s["start"]), ("stop", s["stop"]),
                             ("bytes", raw[s["start"]:s["stop"]])):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["nid"], pa.int64()), pa.array(out["mark"], pa.int64()), pa.array(out["start"], pa.int32()),
             pa.array(out["stop"], pa.int32()), pa.array(out["bytes"], pa.binary())], names=list(out))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(node_id(docs["doc_id"], docs["text"]).alias("nid"), F.xxhash64(text).alias("mark"), text.alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """``nid, mark, spans``: the places to remove from each document that has any, in order."""
    texts = _keyed(docs)
    chunks = stored(texts.mapInArrow(_chunks, "nid long, mark long, start int, stop int, chunk long"), "chunks")
    often = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk")
    spans = chunks.join(often.hint("merge"), "chunk").groupBy("nid", "mark").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = stored(texts.join(spans.hint("merge"), ["nid", "mark"]).dropDuplicates(["nid", "mark"]).mapInArrow(
        _cut, "nid long, mark long, start int, stop int, bytes binary"), "chunk-bytes")
    place = F.struct("nid", "mark", "start")
    first = cut.groupBy("bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = cut.join(first.hint("merge"), "bytes").where(place != F.col("first")).select("nid", "mark", "start", "stop")
    # overlapping chunks of a text become one span
    order = Window.partitionBy("nid", "mark").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach > F.col("start"), 0).otherwise(1)
    joined = gone.withColumn("opens", opens).withColumn("island", F.sum("opens").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("nid", "mark", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.groupBy("nid", "mark").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _removed(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, kept = batch.column(text).to_pylist(), []
        for t, spans in zip(own, batch.column(batch.num_columns - 1).to_pylist()):
            if spans:
                raw, at, parts = t.encode(), 0, []
                for s in spans:
                    parts.append(raw[at:s["start"]])
                    at = s["stop"] + (raw[s["stop"]:s["stop"] + 1] == b"\n")
                t = b"".join([*parts, raw[at:]]).decode()
            kept.append(t)
        columns = batch.columns[:-1]
        columns[text] = pa.array(kept, batch.column(text).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns; repeated chunks, with the line break after them, are gone from the texts."""
    nid, mark, spans = fresh(docs, "nid"), fresh(docs, "mark"), fresh(docs, "spans")
    found = repeats(docs).toDF(nid, mark, spans)
    own = docs.withColumn(nid, node_id(docs["doc_id"], docs["text"])).withColumn(
        mark, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    joined = own.join(found.hint("merge"), [nid, mark], "left").select(*docs.columns, spans)
    at = docs.columns.index("text")
    return joined.mapInArrow(lambda it: _removed(it, at), docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    rows = _keyed(docs).select("nid", "mark", F.octet_length("text").cast("long").alias("size"))
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]), F.lit(0))
    return rows.join(repeats(docs).hint("merge"), ["nid", "mark"], "left").select(
        F.when(F.col("nid") < STAND_IN, F.col("nid")).alias("doc_id"), "size",
        F.greatest(F.coalesce(F.size("spans"), F.lit(0)), F.lit(0)).alias("removed_spans"), gone.alias("removed_bytes"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ","), F.lit("")).alias("spans"))
