"""Personal data: fixed patterns, and identifiers that bootstrapped contexts find.

Four patterns give the base spans (email, ip, card, phone).  They are the seeds.  The words before a seed
are its lexical patterns (the last word, and the last two); candidates are other tokens with at least
``LEAST_DIGITS`` digits, with the patterns before them.  Patterns and values are a graph:

* a value's confidence is 1 for seeds, else that of the best pattern it follows;
* a pattern's confidence is the sum of the confidences of the values it precedes, over all its
  occurrences in the corpus, so that common words are worth little; only patterns with at least
  ``SUPPORT`` different values take part.

Spark scores the graph ``ROUNDS`` times, the seeds' confidence flowing over patterns to values and back.
Candidates behind a pattern of at least ``CONFIDENT`` become spans of kind ``id``.

The texts are read twice: once for spans and candidates, once to count the occurrences of the patterns with
support, whose hashes travel to the tasks in parts of at most ``PATTERNS``.  The graph is narrow tables of
64-bit hashes, pre-aggregated before each shuffle.

Nulls and ties: a null text is an empty one.  Places are code points, ends exclusive.  A row without an
id is scanned like any other.  Repeated rows each give their spans and count as often as they occur.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.llm import common
from tellsign.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "id")
LEAST_DIGITS = 4
SUPPORT = 5
ROUNDS = 3
CONFIDENT = 0.7
PATTERNS = 500_000

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = np.zeros(256, dtype=bool)
_LOCAL[[*range(48, 58), *range(65, 91), *range(97, 123), *b"._%+-"]] = True
# a run of digits that fails at its first digit fails at the others too
_IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(rb"[A-Za-z0-9][A-Za-z0-9._/-]*")
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b < 58)

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
SEEN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.int64()),
                  ("seed", pa.int32()), ("one", pa.int64()), ("two", pa.int64())])
SCANNED = ("doc_id long, base array<struct<kind:int,start:int,stop:int>>, "
           "seen array<struct<start:int,stop:int,value:long,seed:int,one:long,two:long>>")


def emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """From each @: the run of name characters before it and a domain after it."""
    done = 0
    at = raw.find(b"@")
    while at >= 0:
        start = at
        while start > done and _LOCAL[raw[start - 1]]:
            start -= 1
        if start < at and (m := _DOMAIN.match(raw, at + 1)):
            yield start, m.end()
            done = m.end()
        at = raw.find(b"@", max(at + 1, done))


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and start."""
    out = [(0, a, b) for a, b in emails(raw)] if b"@" in raw else []
    for m in _IP.finditer(raw):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(raw):
        digits = m[0].translate(None, b" -")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if b"+" in raw:
        for m in _PHONE.finditer(raw):
            if 8 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def candidates(raw: bytes, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with enough digits that meet no base span."""
    taken = sorted((a, b) for _, a, b in base)
    for m in _TOKEN.finditer(raw):
        if len(m[0]) - len(m[0].translate(None, b"0123456789")) >= LEAST_DIGITS and not any(
                a < m.end() and m.start() < b for a, b in taken):
            yield m.start(), m.end()


def pattern_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a slice, the hash of the word before it and of the two before it (0: none)."""
    one, two = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(words) > 1:
        one[1:] = np.where(place[1:] >= 1, words[:-1], 0)
    if len(words) > 2:
        two[2:] = np.where(place[2:] >= 2, common.fold_words([words[:-2], words[1:-1]]), 0)
    return one, two


def _value(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw.lower(), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in common.slices(batch.column(1)):
            n = end - first
            base: list[list] = [[] for _ in range(n)]
            seen: list[list] = [[] for _ in range(n)]
            marks = np.concatenate([[0], np.cumsum(((data >= 48) & (data < 58)) | (data == 64))])
            rows = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
            if len(rows):
                starts, ends, counts = common.word_bounds(data, offsets)
                one, two = pattern_hashes(common.hash_spans(data, starts, ends), counts)
                one, two = one.view(np.int64), two.view(np.int64)
            for row in rows:
                raw = data[offsets[row]:offsets[row + 1]].tobytes()
                found = base_spans(raw)
                spans = [(k, a, b, 1) for k, a, b in found] + [(4, a, b, 0) for a, b in candidates(raw, found)]
                if not spans:
                    continue
                wide = None if raw.isascii() else np.concatenate(
                    [[0], np.cumsum((data[offsets[row]:offsets[row + 1]] & 0xC0) != 0x80)])
                for k, a, b, seed in spans:
                    word = int(np.searchsorted(starts, offsets[row] + a, "right")) - 1
                    lo, hi = (a, b) if wide is None else (int(wide[a]), int(wide[b]))
                    if seed:
                        base[row].append({"kind": k, "start": lo, "stop": hi})
                    seen[row].append({"start": lo, "stop": hi, "value": _value(raw[a:b]), "seed": seed,
                                      "one": int(one[word]), "two": int(two[word])})
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, n), pa.array(base, pa.list_(SPAN)), pa.array(seen, pa.list_(SEEN)),
            ], names=["doc_id", "base", "seen"])


def _count_patterns(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often a word follows each of the (sorted) patterns."""
    total = np.zeros(len(wanted), dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in common.slices(batch.column(0)):
            for hashes in pattern_hashes(*common.words_of(data, offsets)):
                own = hashes.view(np.int64)
                at = np.searchsorted(wanted, own)
                at[at == len(wanted)] = 0
                total += np.bincount(at[wanted[at] == own], minlength=len(wanted))
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(wanted[full]), pa.array(total[full])], names=["pattern", "n"])


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often each of ``patterns`` stands before a word, over all texts."""
    spark = docs.sparkSession
    parts = max(1, -(-patterns.count() // (PATTERNS // 2)))
    counted = []
    for part in range(parts):
        own = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        wanted = np.sort(np.array([r[0] for r in own.collect()], dtype=np.int64))
        if len(wanted):
            shared = spark.sparkContext.broadcast(wanted)
            counted.append(docs.select("text").mapInArrow(
                lambda it, shared=shared: _count_patterns(it, shared.value), "pattern long, n long"))
    if not counted:
        return patterns.select("pattern", F.lit(0).cast("long").alias("total")).limit(0)
    return reduce(DataFrame.unionByName, counted).groupBy("pattern").agg(F.sum("n").alias("total"))


def confident_patterns(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """``pattern, confidence`` of the patterns that the graph of patterns and values finds reliable."""
    seen = scanned.select(F.explode("seen").alias("s")).select(
        F.explode(F.array("s.one", "s.two")).alias("pattern"), "s.value", "s.seed").where("pattern <> 0")
    edges = stored(seen.groupBy("pattern", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "pii-edges")
    backed = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= SUPPORT)
    totals = stored(occurrences(docs, stored(backed.select("pattern"), "pii-patterns")), "pii-totals")
    own = edges.join(totals, "pattern")
    confidence = own.select("pattern", "value", "n", "seed", "total", F.col("seed").cast("double").alias("c"))
    for turn in range(ROUNDS):
        patterns = stored(confidence.groupBy("pattern").agg(
            F.least(F.sum(F.col("c") * F.col("n")) / F.max("total"), F.lit(1.0)).alias("confidence")), "pii-scores")
        if turn == ROUNDS - 1:
            break
        values = own.join(patterns, "pattern").groupBy("value").agg(
            F.max(F.when(F.col("seed") == 1, 1.0).otherwise(F.col("confidence"))).alias("c"))
        confidence = own.join(values, "value")
    return patterns.where(F.col("confidence") >= CONFIDENT)


def find_personal(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: the base spans and all spans of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    row = F.monotonically_increasing_id()
    scanned = stored(own.mapInArrow(_scan, SCANNED).withColumn("row", row), "pii-scan")
    good = confident_patterns(docs, scanned)
    tried = scanned.select("row", F.explode("seen").alias("s")).where("s.seed = 0").select(
        "row", "s.start", "s.stop", F.explode(F.array("s.one", "s.two")).alias("pattern"))
    more = tried.join(good.select("pattern"), "pattern", "left_semi").groupBy("row").agg(F.collect_set(
        F.struct(F.lit(4).alias("kind"), "start", "stop")).alias("more"))
    none = F.array().cast("array<struct<kind:int,start:int,stop:int>>")
    return scanned.join(more, "row", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(common.documents(spark, sf_dir))
    kinds, names = F.transform("base", lambda s: s["kind"]), F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")

    number = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}")
              for k in range(4)]
    return found.select("doc_id", *number, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
