"""Best-fit packing of tokenized documents into sequences of bounded length.

Tokens.  A document is the ids of its whole text and an end id.  Texts are cut where a word of the tokenizer ends in any
case (after a letter before a sign, before white space, ...), so the parts can be tokenized apart: each different part of a
batch once, single words of letters by the vocabulary's model alone, and the ids are put together by
number.  That holds for byte-level vocabularies that part runs of letters, digits and signs.  Documents longer than
``capacity`` are cut into pieces of exactly that length; what is left over is the first piece.

Packing works on (item, size) only and in rounds, as a tree.  In the first round items are dealt
by hash to tasks of about ``TASK_ITEMS``.  A task packs best fit, largest first: an item goes to the open bin it fills
best, else to a new one.  Bins with fewer than ``NEARLY`` free places are emitted; of the others the
``RISING`` emptiest become items of the next round, where ``FAN`` tasks meet in one, until one task is left.

What a round leaves to the next is bounded, and nothing is lost by that.  After best fit at most one bin of a task is at
most half full (the items of a second would have gone into the first), and of two bins that can be merged one is
at most half full.  So a task of the next round can save at most one sequence for each of its ``FAN`` tasks, and for
each of them an emptiest bin is as good a partner as any.  Bins that do not rise are emitted as they are.

Rounds are written tables.  No task holds more than its share of items, whatever the sizes or ids are.

Nulls and ties: a null text is an empty one, which is the end id alone; a null id stays null; repeated rows are packed
each for itself.  Of equal sizes the smaller item number goes first.  An empty table gives an empty result.
The strings of special tokens are ordinary text.  The tokenizer's file is read by each executor from ``path``.
"""
from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.llm import common
from tellsign.llm.common import stored

CAPACITY = 2048
END_ID = 0
TASK_ITEMS = 1 << 16
FAN = 16
RISING = TASK_ITEMS // FAN
NEARLY = 8
SLICE = 8 << 20
CACHED_PARTS, CACHED_BYTES = 1 << 19, 32
#: One word of the tokenizer: letters, digits or signs, with a blank before it or none.
WORD = re.compile(r" ?(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Byte-level vocabularies write visible bytes of Latin-1 as they are and the others, in order, from U+0100 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
LETTERS = {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - _VISIBLE))}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Kinds of bytes: letters, digits, other visible ASCII but the apostrophe, apostrophe, white space, all others.
_LETTER, _DIGIT, _SIGN, _QUOTE, _WHITE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x27] = _QUOTE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _WHITE
# whether a word of the tokenizer always ends between two bytes of these kinds
_ENDS = np.zeros((6, 6), dtype=bool)
_ENDS[[_LETTER, _DIGIT, _SIGN, _QUOTE], _WHITE] = True
_ENDS[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = True
_ENDS[_DIGIT, [_LETTER, _SIGN, _QUOTE]] = True
_ENDS[_SIGN, [_LETTER, _DIGIT]] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where a word of the tokenizer ends whatever surrounds them."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    kind = _KIND[data]
    ends = _ENDS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    # characters of two bytes from C3 on are no white space
    two = (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
    ends[1:] |= two & (data[1:-1] >= 0x80) & (kind[2:] == _WHITE)
    return np.flatnonzero(ends) + 1


class Encoder:
    """Token ids of whole slices; parts of a text that were seen are not tokenized again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.seen: dict[str, list[int]] = {}

    def _ids(self, parts: list[str]) -> list[list[int]]:
        found = [self.seen.get(p) for p in parts]
        new = [i for i, f in enumerate(found) if f is None]
        if len(self.seen) + len(new) > CACHED_PARTS:
            self.seen = {}
        single, word = WORD.fullmatch, self.tokenizer.model.tokenize
        for i in new:
            if single(part := parts[i]):
                if part.isascii():
                    part = part.replace(" ", LETTERS[0x20])
                else:
                    part = part.encode().decode("latin-1").translate(LETTERS)
                found[i] = [t.id for t in word(part)]
        others = [i for i in new if found[i] is None]
        for at in range(0, len(others), 4096):
            block = others[at:at + 4096]
            for i, e in zip(block, self.tokenizer.encode_batch([parts[i] for i in block], add_special_tokens=False)):
                found[i] = e.ids
        for i in new:
            if len(parts[i]) <= CACHED_BYTES and len(self.seen) < CACHED_PARTS:
                self.seen[parts[i]] = found[i]
        return found

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and the number of ids of each row."""
        bounds = np.sort(np.concatenate([offsets, cuts(data)]), kind="stable")
        bounds = bounds[np.append(True, bounds[1:] != bounds[:-1])]
        if len(bounds) < 2:
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets) - 1, dtype=np.int64)
        parts = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [
            None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        codes, own = parts.indices.to_numpy(), self._ids(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        flat = np.fromiter((x for ids in own for x in ids), dtype="<u4", count=int(sizes.sum()))
        each = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(bounds, offsets)])


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, ids_too: bool) -> Iterator[pa.RecordBatch]:
    encode = _encoder(path)
    for batch in batches:
        for first, end, data, offsets in common.slices(batch.column(1), SLICE):
            ids, counts = encode(data, offsets)
            totals = counts + 1
            whole = np.full(len(ids) + len(counts), end_id, dtype="<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            each = -(-totals // capacity)
            row = np.repeat(np.arange(len(counts)), each)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            ahead = (totals - (each - 1) * capacity)[row]
            start = np.where(piece == 0, 0, ahead + (piece - 1) * capacity)
            length = np.where(piece == 0, ahead, capacity)
            at = (np.cumsum(totals) - totals)[row] + start
            crc = [zlib.crc32(whole[a:a + n]) for a, n in zip(at, length)]
            columns = [batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start),
                       pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids_too:
                ends = np.append(at, at[-1] + length[-1]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids_too: bool = False) -> DataFrame:
    """A stored table of the pieces of all documents with a number ``item`` each, and their ``ids`` if wanted."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    cut = rows.mapInArrow(lambda it: _pieces(it, path, capacity, end_id, ids_too), PIECES + (", ids array<int>" if ids_too else ""))
    return stored(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item the item that opened its bin and the place in the bin; for each of the former the fill.

    The bins that are open are kept by free places; the bits of ``free`` say which numbers occur.
    """
    head, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    left = np.zeros(len(sizes), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i, size in zip(order := np.argsort(-sizes, kind="stable").tolist(), sizes[order].tolist()):
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            opener = waiting[room].pop()
            if not waiting[room]:
                free &= ~(1 << room)
        else:
            room, opener = capacity, i
        head[i], offset[i] = opener, capacity - room
        room -= size
        left[opener] = room
        if room:
            waiting[room].append(opener)
            free |= 1 << room
    return head, offset, capacity - left


def _round(capacity: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def packed_task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        item = pdf["item"].to_numpy()
        head, offset, fill = best_fit(pdf["size"].to_numpy(), capacity)
        rises = np.zeros(len(item), dtype=bool)
        if not last:
            under = np.flatnonzero((head == np.arange(len(item))) & (capacity - fill >= NEARLY))
            rises[under[np.argsort(fill[under], kind="stable")[:RISING]]] = True
        return pd.DataFrame({"task": pdf["task"], "item": item, "bin": item[head], "offset": offset, "fill": fill, "rises": rises})

    return packed_task


def place(items: DataFrame, capacity: int = CAPACITY, task_items: int = TASK_ITEMS) -> DataFrame:
    """``item, sequence_id, offset`` of each row of ``items`` (``item``: a unique number, ``size``: 1 to ``capacity``)."""
    full = items.where(F.col("size") >= capacity).select(
        "item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("size") < capacity)
    tasks = max(1, -(-rest.count() // task_items))
    rows = rest.select(F.pmod(F.xxhash64("item"), F.lit(tasks)).alias("task"), "item", F.col("size").cast("long").alias("size"))
    rounds = []
    while True:
        last = tasks == 1
        rounds.append(stored(rows.groupBy("task").applyInPandas(
            _round(capacity, last), "task long, item long, bin long, offset long, fill long, rises boolean"), "packed"))
        if last:
            break
        tasks = -(-tasks // FAN)
        rows = rounds[-1].where("rises").select(
            F.floor(F.col("task") / FAN).alias("task"), "item", F.col("fill").alias("size"))
    placed = rounds[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for earlier in reversed(rounds[:-1]):
        above = placed.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("base"))
        placed = earlier.select("item", "bin", "offset").join(above.hint("merge"), "bin", "left").select(
            "item", F.coalesce("sequence_id", "bin").alias("sequence_id"),
            (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
    return full.unionByName(placed)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids_too: bool = False) -> DataFrame:
    """All pieces with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    own = pieces(docs, path, capacity, end_id, ids_too)
    places = place(own.select("item", F.col("length").alias("size")), capacity)
    return own.join(places.hint("merge"), "item").drop("item")


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, from pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
