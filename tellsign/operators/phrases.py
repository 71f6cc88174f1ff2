"""Phrases of a table of any size, found in whole texts.

A phrase is one or more words (letters, digits, underscore) with single blanks between them.  Keywords are found in
lower-cased text, their words parted by exactly one blank, and each counts on its own.  Phrases of kind ``regex`` are found
without regard to case, their words parted by any white space; those of a family count as one alternation in the
order of ``ord``: of overlapping ones the first to start counts, of those with one start the first in order.

Texts are cut into words where they are.  A bitmap of bounded size says which words may start a phrase, another one, as
large as the table needs (up to 64 MB), which runs of words may be one; only runs that pass are joined with the phrases by the
run itself, which is the exact test.  What the bitmaps let through in vain costs rows, never results.
Up to a million phrases are broadcast; beyond that the runs that pass are shuffled.  Then the messages are taken in up to ``SLICES``
slices by their key, one after the other: the runs and places of one slice are on disk at a time, and of each slice only the counts stay.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellsign.functions import bitmap
from tellsign.functions import text as T
from tellsign.functions.signals import KINDS
from tellsign.operators.clean import MOST_BROADCAST
from tellsign.session import estimated_bytes, written

MAX_FAMILIES = 200
SLICES, SLICE_BYTES = 8, 128 << 20
WORD, WORD_AND_GAP = f"{T.WORD}++", f"{T.WORD}++([^\\p{{L}}\\p{{N}}_]*+)"
PHRASE = f"(?U)^{T.WORD}+( {T.WORD}+)*$"


def _first(word: Column) -> Column:
    """Key of a word that starts a phrase; the blank parts it from the phrases themselves."""
    return F.xxhash64(F.concat(word, F.lit(" ")))


def _good(phrases: DataFrame) -> DataFrame:
    run = F.when(F.col("kind") == "regex", T.folded(F.col("phrase"))).otherwise(F.col("phrase"))
    return phrases.withColumn("run", run).where(
        F.col("kind").isin(*KINDS) & F.col("family").isNotNull() & F.col("run").rlike(PHRASE))


def usable(phrases: DataFrame) -> DataFrame:
    """``ord, family, kind, phrase, run`` of the phrases that can be found; ``run`` is the form to look for.

    Repeated phrases of a family and kind count once, at their first place.
    """
    return _good(phrases).groupBy("family", "kind", "run").agg(F.min(F.struct("ord", "phrase")).alias("at")).select(
        "at.ord", "family", "kind", "at.phrase", "run")


def refused(phrases: DataFrame) -> DataFrame:
    """Rows that are no phrases, or of an unknown kind or no family."""
    good = F.col("kind").isin(*KINDS) & F.col("family").isNotNull() & F.col("phrase").rlike(PHRASE)
    return phrases.where(~F.coalesce(good, F.lit(False)))


@dataclass
class PhraseTable:
    """Usable phrases as a written table, and what the texts are tested with."""
    known: DataFrame  # a phrase that is its own run is null
    n: int
    lengths: list[int]
    firsts: bytes
    runs: DataFrame | None  # the bitmap of a table too large to be broadcast


def prepared(phrases: DataFrame | PhraseTable) -> PhraseTable:
    """The table worked out once, for all that is asked of it."""
    if isinstance(phrases, PhraseTable):
        return phrases
    known = written(usable(phrases).withColumn("phrase", F.when(F.col("phrase") != F.col("run"), F.col("phrase"))), "phrases")
    n = known.count()
    lengths = sorted(r[0] for r in known.select(F.size(F.split("run", " "))).distinct().collect())
    firsts = bitmap.build(known.select(F.substring_index("run", " ", 1).alias("word")).distinct().select(_first(F.col("word")).alias("key")))
    runs = None if n <= MOST_BROADCAST else written(bitmap.table(known.select(F.xxhash64("run").alias("key")), n), "phrase-bits")
    return PhraseTable(known, n, lengths, firsts, runs)


def spans(messages: DataFrame, phrases: DataFrame | PhraseTable) -> DataFrame:
    """``msg_id, family, kind, ord, phrase, start, size``: every place of every phrase, in words; overlaps too."""
    table = prepared(phrases)
    known, lengths, firsts = table.known, table.lengths, table.firsts
    low, fold = T.lowered(F.col("text")), T.folded(F.col("text"))
    # outer: else Spark tests the arrays' sizes first, below the projections, and repeats the text work for it
    forms = messages.select("msg_id", low.alias("low"), fold.alias("fold")).select("msg_id", F.inline_outer(
        F.when(F.col("low") == F.col("fold"), F.array(F.struct(F.col("low").alias("form"), F.lit(None).cast("string").alias("only"))))
        .otherwise(F.array(F.struct(F.col("low").alias("form"), F.lit("keyword").alias("only")),
                           F.struct(F.col("fold").alias("form"), F.lit("regex").alias("only"))))))
    cut = forms.select("msg_id", "only", F.regexp_extract_all("form", F.lit(WORD), F.lit(0)).alias("words"),
                       F.regexp_extract_all("form", F.lit(WORD_AND_GAP), F.lit(1)).alias("gaps"))
    # One row a word and length; the arrays stay in their row's memory and only what is left of the rows is moved.
    places = cut.select("*", F.posexplode_outer("words").alias("start", "word")).where(
        F.col("word").isNotNull() & bitmap.may_hold(firsts, _first(F.col("word"))))
    size = F.col("size")
    sized = places.select("*", F.explode(F.array(*[F.lit(k) for k in lengths]).cast("array<int>")).alias("size")).where(
        F.col("start") + size <= F.size("words"))
    # Gaps hold no letters, so a letter parts them.
    between = sized.withColumn("between", F.array_join(F.slice("gaps", F.col("start") + 1, size - 1), "a")).withColumn(
        "blanks", F.col("between") == F.when(size > 1, F.concat(F.expr("repeat(' a', size - 2)"), F.lit(" "))).otherwise(""))
    found = between.where(F.col("blanks") | F.col("between").rlike(f"(?U)^({T.GAP}(a{T.GAP})*)?$")).select(
        "msg_id", "only", "start", "size", "blanks", F.array_join(F.slice("words", F.col("start") + 1, size), " ").alias("run"))
    if table.runs is None:
        found = found.join(F.broadcast(known), "run")
    else:
        found = bitmap.held_by(found, F.xxhash64("run"), table.runs, table.n).join(known, "run")
    return found.where(
        ((F.col("kind") == "regex") | F.col("blanks")) & F.coalesce(F.col("kind") == F.col("only"), F.lit(True))).select(
        "msg_id", "family", "kind", "ord", F.coalesce("phrase", "run").alias("phrase"), "start", "size")


def _without_overlaps(places: Column) -> Column:
    """Number of places (``alone, start, ord, size``, in order) that start after the end of the last one counted."""
    begin = F.struct(F.lit(None).cast("string").alias("alone"), F.lit(0).alias("until"), F.lit(0).alias("n"))

    def step(state: Column, x: Column) -> Column:
        free = (x["start"] >= state["until"]) | ~x["alone"].eqNullSafe(state["alone"])
        return F.when(free, F.struct(x["alone"].alias("alone"), (x["start"] + x["size"]).alias("until"), (state["n"] + 1).alias("n"))
                      ).otherwise(state)

    return F.aggregate(places, begin, step, lambda s: s["n"])


def _slices(messages: DataFrame) -> list[DataFrame]:
    """The messages by a hash of their key, in parts of about ``SLICE_BYTES`` of input, but at most ``SLICES`` parts."""
    size = estimated_bytes(messages)
    n = SLICES if size is None else max(1, min(SLICES, -(-size // SLICE_BYTES)))
    which = F.pmod(F.xxhash64("msg_id"), F.lit(n))
    return [messages.where(which == i) for i in range(n)] if n > 1 else [messages]


def _counted(messages: DataFrame, phrases: DataFrame | PhraseTable, keys: list[str], alone: Column) -> DataFrame:
    table = prepared(phrases)
    place = F.struct(alone.alias("alone"), "start", "ord", "size")

    def counted(part: DataFrame) -> DataFrame:
        return spans(part, table).groupBy("msg_id", *keys).agg(F.sort_array(F.collect_list(place)).alias("places")).select(
            "msg_id", *keys, _without_overlaps(F.col("places")).alias("hits"))

    if table.runs is None:
        return counted(messages)
    return reduce(DataFrame.unionByName, [written(counted(part), "phrase-hits") for part in _slices(messages)])


def family_hits(messages: DataFrame, phrases: DataFrame | PhraseTable) -> DataFrame:
    """``msg_id, family, kind, hits`` of the families that a message has hits of."""
    alone = F.when(F.col("kind") == "keyword", F.col("phrase")).otherwise("")
    return _counted(messages, phrases, ["family", "kind"], alone)


def evidence(messages: DataFrame, phrases: DataFrame | PhraseTable) -> DataFrame:
    """``msg_id, family, kind, phrase, hits``: each phrase counted on its own."""
    return _counted(messages, phrases, ["family", "kind", "phrase"], F.lit(""))


def families(phrases: DataFrame | PhraseTable, kinds: Iterable[str] = tuple(KINDS)) -> list[tuple[str, str]]:
    """(family, kind) of the table, in order; each becomes a column, so their number is checked."""
    good = phrases.known if isinstance(phrases, PhraseTable) else _good(phrases)
    found = sorted(tuple(r) for r in good.where(F.col("kind").isin(*kinds)).select(
        "family", "kind").distinct().limit(MAX_FAMILIES + 1).collect())
    if len(found) > MAX_FAMILIES:
        raise ValueError(f"the phrase table has more than {MAX_FAMILIES} families")
    return found


def with_hit_counts(messages: DataFrame, phrases: DataFrame | PhraseTable, names: list[tuple[str, str]]) -> DataFrame:
    """Add ``re_<family>`` and ``kw_<family>`` for each (family, kind).

    Hits leave the texts as narrow rows; the counts come back by a join on ``msg_id``, which moves the texts once if the
    counts are too many to be broadcast.
    """
    columns = {f"{KINDS[k]}_{f}": (F.col("family") == f) & (F.col("kind") == k) for f, k in names}
    if not names:
        return messages
    counts = family_hits(messages, phrases).groupBy("msg_id").agg(
        *[F.sum(F.when(own, F.col("hits"))).alias(c) for c, own in columns.items()])
    joined = messages.join(counts, "msg_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in columns})
