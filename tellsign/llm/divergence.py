"""How the sources of a language differ in their words, with strings put in late.

One pass over the texts counts terms exactly by string, some slices of a task at a time, and writes one row for each
language and term: a 64-bit digest, the term, its documents, and its count in each source.  From there on only digests move:
one shuffle by language and digest brings all counts of a term together, whose shares and divergences are narrow rows of
fixed width.  Strings are read once more on the side, as the least and the greatest term of each digest (pre-aggregated by
task).  Where these differ, several terms share the digest, and its rows are split: their key becomes digest and term.
At the end terms are joined back for the rows that are kept.  Sources go by number too; that two of a language share
one is checked, and an error.

Pairs of sources are summed up in blocks of terms.  A block holds a bounded number of (term, source) cells, so a language is many
tasks and no pairs are written but those of the result, once a block.  The ``RANKS`` best terms of a group are found in
two steps: by value only, which gives the value of the last one, then by value and term among those not below it.

Shares, for a group or a language with N occurrences of the V kept terms of its language, are
``p = 1 + floor(10**9 * (count + 1) / (N + V))`` and the divergence of p from q is ``floor((p - q)**2 / q)``.  Sums of
more than 63 bits are an error.

Nulls and ties: null text, language and source are empty strings; a repeated row is a document of its own; a group without
terms has all counts 0; in a language without kept terms all pairs are 0.  Equal values rank by item, in
byte order.  An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellsign.llm import common
from tellsign.llm.common import stored

LEAST_DOCUMENTS = 3
RANKS = 200
SCALE = 1_000_000_000
DIGEST_BITS = 64
CELLS = 1 << 18
FLUSH_ROWS = 1 << 22
MOST_SHARED = 1 << 20
SLICE = 8 << 20
TERM_KEY = ["lang", "digest", "split"]

# Bytes that part terms: ASCII but letters.
_OUTSIDE = np.zeros(256, dtype=bool)
_OUTSIDE[:128] = True
_OUTSIDE[65:91] = _OUTSIDE[97:123] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a slice in order, and the number of terms of each row."""
    starts, ends, counts = common.word_bounds(data, offsets, _OUTSIDE)
    letters = _LOWER[data[~_OUTSIDE[data]]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [
        None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode(), counts


def digests(terms: pa.Array, bits: int) -> np.ndarray:
    """A hash of ``bits`` bits of each term."""
    out = [common.hash_spans(data, offsets[:-1], offsets[1:], lower=False) for _, _, data, offsets in common.slices(terms)]
    return (np.concatenate(out or [np.zeros(0, np.uint64)]) >> np.uint64(64 - bits)).view(np.int64)


class _Counts:
    """Counts of terms over some slices: rows (language, term, source) with documents and occurrences."""

    def __init__(self, bits: int):
        self.bits, self.langs = bits, {}
        self.clear()

    def clear(self) -> None:
        self.terms: list[pa.Array] = []
        self.rows: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: pa.Array, source: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        terms, counts = _terms(data, offsets)
        if not len(terms):
            return
        many = len(terms.dictionary)
        own, n = np.unique(np.repeat(np.arange(len(counts)), counts) * many + terms.indices.to_numpy(), return_counts=True)
        row, code = own // many, own % many
        lang = lang.dictionary_encode()
        numbers = np.array([self.langs.setdefault(x, len(self.langs)) for x in lang.dictionary.to_pylist()])
        sources, at = np.unique(source, return_inverse=True)
        key = (numbers[lang.indices.to_numpy()][row] * len(sources) + at[row]) * many + code
        key, at, docs = np.unique(key, return_inverse=True, return_counts=True)
        occurrences = np.zeros(len(key), dtype=np.int64)
        np.add.at(occurrences, at, n)
        group = key // many
        self.rows.append(np.stack([group // len(sources), key % many + sum(map(len, self.terms)), sources[group % len(sources)],
                                   docs, occurrences]))
        self.terms.append(terms.dictionary)
        self.held += len(key)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            all_terms = pa.concat_arrays(self.terms).dictionary_encode()
            lang, code, source, docs, n = np.concatenate(self.rows, axis=1)
            code = all_terms.indices.to_numpy()[code]
            order = np.lexsort((source, code, lang))
            lang, code, source, docs, n = (x[order] for x in (lang, code, source, docs, n))
            new_term = np.append(True, (lang[1:] != lang[:-1]) | (code[1:] != code[:-1]))
            new_cell = np.flatnonzero(new_term | np.append(True, source[1:] != source[:-1]))
            heads = np.flatnonzero(new_term)
            lists = pa.array(np.append(np.searchsorted(new_cell, heads), len(new_cell)).astype(np.int32))
            names, codes = pa.array(list(self.langs), pa.string()), pa.array(code[heads])
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(lang[heads])), pa.array(digests(all_terms.dictionary, self.bits)).take(codes),
                 all_terms.dictionary.take(codes), pa.array(np.add.reduceat(docs, heads)),
                 pa.ListArray.from_arrays(lists, pa.array(source[new_cell])),
                 pa.ListArray.from_arrays(lists, pa.array(np.add.reduceat(n, new_cell)))],
                names=["lang", "digest", "term", "docs", "sids", "ns"])
        self.clear()


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    counts = _Counts(bits)
    for batch in batches:
        for first, end, data, offsets in common.slices(batch.column(2), SLICE):
            counts.add(batch.column(0).slice(first, end - first), batch.column(1).to_numpy()[first:end], data, offsets)
            if counts.held >= FLUSH_ROWS:
                yield from counts.flush()
    yield from counts.flush()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in whole numbers of any size."""
    def wide(x: Column) -> Column:
        return x.cast("decimal(20,0)")

    exact = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + kept))
    small = F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total + kept)
    return 1 + F.when(count < 2**63 // SCALE - 1, small).otherwise(exact)


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(_key, cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of a block for all pairs of sources of the language."""
    sources = sources.sort_values("source", ignore_index=True)
    names, empty = sources["source"].to_numpy(), sources["none"].to_numpy()
    terms, at = np.unique(np.rec.fromarrays([cells["digest"].to_numpy(np.int64), cells["split"].fillna("").to_numpy(str)]),
                          return_inverse=True) if len(cells) else (np.zeros(0), np.zeros(0, int))
    share = np.repeat(empty[:, None], len(terms), axis=1)
    share[np.searchsorted(names, cells["source"].to_numpy()), at] = cells["p"].to_numpy()
    out = np.zeros((len(names), len(names)), dtype=np.int64)
    for i in range(len(names)):
        each = (share[i] - share) ** 2 // share
        if len(terms) and each.sum(axis=1, dtype=float).max() > 2.0**62:
            raise OverflowError("the divergence of two sources exceeds 63 bits")
        out[i] = each.sum(axis=1)
    i, j = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": sources["lang"].iloc[0], "source": names[i], "item": names[j], "value": out[i, j]})


class Audit:
    """Tables of one audit: ``words`` (digest to strings), ``own`` (kept terms by group), ``groups`` and ``langs``."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS, bits: int = DIGEST_BITS):
        rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        rows = rows.withColumn("sid", F.xxhash64("source"))
        parts = stored(rows.select("lang", "sid", "text").mapInArrow(
            lambda it: _counted(it, bits),
            "lang string, digest long, term string, docs long, sids array<long>, ns array<long>"), "terms")
        self.words = stored(parts.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "words")
        shared = self.words.where("low <> high").select("digest", F.lit(True).alias("shared"))
        many = shared.count()
        if many:
            parts = parts.join(F.broadcast(shared) if many <= MOST_SHARED else shared.hint("merge"), "digest", "left")
        split = F.when(F.col("shared"), F.col("term")) if many else F.lit(None).cast("string")
        # one shuffle brings all rows of a term together; a task has written it once, whatever its sources
        cells = parts.withColumn("split", split).select("lang", "digest", "split", "docs", "sids", "ns").repartition(
            "lang", "digest").select("lang", "digest", "split", "docs", F.posexplode(F.arrays_zip("sids", "ns")).alias("at", "cell"))
        counts = cells.groupBy(*TERM_KEY, F.col("cell.sids").alias("sid")).agg(
            F.sum("cell.ns").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("docs"))).alias("docs"))
        term = Window.partitionBy(*TERM_KEY)
        self.own = stored(counts.withColumn("in_docs", F.sum("docs").over(term)).where(F.col("in_docs") >= least).select(
            *TERM_KEY, "sid", "n", F.sum("n").over(term).alias("lang_n"),
            (F.row_number().over(term.orderBy("sid")) == 1).alias("head")), "kept")
        self.langs = self.own.groupBy("lang").agg(F.count_if("head").alias("kept"), F.sum("n").alias("lang_total"))
        totals = self.own.groupBy("lang", "sid").agg(F.sum("n").alias("total"))
        known = rows.groupBy("lang", "sid").agg(F.min("source").alias("source"), F.max("source").alias("other")).select(
            "lang", "sid", F.when(F.col("source") == F.col("other"), F.col("source")).otherwise(
                F.raise_error(F.lit("two sources share a number"))).alias("source"))
        zero = F.lit(0).cast("long")
        self.groups = stored(known.join(totals, ["lang", "sid"], "left").join(self.langs, "lang", "left").select(
            "lang", "sid", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"),
            F.coalesce("lang_total", zero).alias("lang_total"),
            F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources")), "groups")

    def shares(self) -> DataFrame:
        """Kept terms by group, with their shares in the group (``p``) and in the language (``q``)."""
        return self.own.join(self.groups, ["lang", "sid"]).withColumn(
            "p", _share(F.col("n"), F.col("total"), F.col("kept"))).withColumn(
            "q", _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))

    def terms(self, ranks: int = RANKS) -> DataFrame:
        """``lang, source, item, value, rank``: the terms of each group that its language has less of."""
        group = ["lang", "source"]
        more = self.shares().where("p > q").select(*group, "digest", "split", _divergence(F.col("p"), F.col("q")).alias("value"))
        by_value = Window.partitionBy(*group).orderBy(F.desc("value"), "digest")
        last = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks).groupBy(
            *group).agg(F.min("value").alias("last"))
        near = more.join(last, group).where("value >= last")
        named = near.join(self.words.select("digest", "low"), "digest").select(
            *group, F.coalesce("split", "low").alias("item"), "value")
        return _ranked(named).where(F.col("rank") <= ranks)

    def pairs(self, cells: int = CELLS) -> DataFrame:
        """``lang, source, item, value, rank``: the divergence of each source from each other one of its language."""
        many = F.ceil(F.col("kept") * F.col("sources") / cells)
        blocks = self.groups.withColumn("blocks", F.greatest(many, F.lit(1))).withColumn(
            "none", F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(1))
        sides = blocks.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "none")
        rows = self.shares().withColumn("block", F.pmod(F.xxhash64("digest", "split"), F.greatest(
            F.ceil(F.col("kept") * F.col("sources") / cells), F.lit(1)))).select(
            "lang", "block", "digest", "split", F.col("source").alias("source"), "p")
        sums = rows.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInPandas(
            _pair_sums, "lang string, source string, item string, value long")
        return _ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    def report(self) -> DataFrame:
        parts = [df.withColumn("part", F.lit(name)) for name, df in (("pair", self.pairs()), ("term", self.terms()))]
        return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Audit(common.documents(spark, sf_dir)).report()
