"""Lexicon sentiment as a column expression, the same in batch and streaming jobs."""
from __future__ import annotations

import zlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.functions import bitmap
from tellsign.session import written

TOKEN = r"[a-z\p{L}\p{N}_']++"
MAX_LEXICON = 20_000
PER_BUCKET = 4
#: Words of a lexicon table that are broadcast, and of one part of it.
MOST_WORDS, PART_WORDS = 8_000_000, 1_000_000


def tokens(lowered_text: Column) -> Column:
    return F.regexp_extract_all(lowered_text, F.lit(TOKEN), F.lit(0))


def _dictionary(entries: Mapping[str, float]):
    """Constant-time lookup of a word in a literal table split by hash.

    A map column is searched linearly, so the words are spread over many small maps.  The
    table is part of the plan, hence the size check.
    """
    if len(entries) > MAX_LEXICON:
        raise ValueError(f"sentiment lexicon has {len(entries)} words, limit {MAX_LEXICON}")
    width = max(1, len(entries) // PER_BUCKET)
    buckets: list[list] = [[F.lit(""), F.lit(None).cast("double")] for _ in range(width)]
    for word, value in entries.items():
        buckets[zlib.crc32(word.encode()) % width] += [F.lit(word), F.lit(float(value))]
    table = F.array(*[F.create_map(*bucket) for bucket in buckets])

    def look_up(word: Column) -> Column:
        slot = (F.crc32(word) % F.lit(width)).cast("int")
        return F.try_element_at(F.get(table, slot), word)

    return look_up


def valence_sum(
    words: Column,
    lexicon: Mapping[str, float] | None = None,
    negators=tuple(fixed.SENTIMENT_NEGATORS),
    boosters: Mapping[str, float] | None = None,
) -> Column:
    """Sum of the valences of a message's words.

    A booster directly before a word moves its valence away from zero (or towards it); a
    negator among the three words before it turns it round and weakens it.
    """
    lexicon = fixed.SENTIMENT_LEXICON if lexicon is None else lexicon
    boosters = fixed.SENTIMENT_BOOSTERS if boosters is None else boosters
    if not lexicon:
        return F.lit(0.0)
    valence = _dictionary(lexicon)
    boost = _dictionary(boosters) if boosters else (lambda word: F.lit(None).cast("double"))
    # A membership test on a literal set is cheap; values and context are only looked up at
    # the few places that pass it.
    places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*lexicon), i)))
    negator_list = F.array(*[F.lit(n) for n in negators])

    def adjusted(i: Column) -> Column:
        v = valence(F.get(words, i))
        step = F.coalesce(boost(F.get(words, i - 1)), F.lit(0.0))
        v = v + F.signum(v) * step
        back = F.slice(words, F.greatest(i - (fixed.SENTIMENT_LOOKBACK - 1), F.lit(1)),
                       F.least(i, F.lit(fixed.SENTIMENT_LOOKBACK)))
        negated = F.arrays_overlap(back, negator_list)
        return F.when(negated, v * F.lit(fixed.SENTIMENT_NEGATION_FACTOR)).otherwise(v)

    return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + adjusted(i))


def valence_sums(
    messages: DataFrame,
    lexicon: DataFrame,
    negators=tuple(fixed.SENTIMENT_NEGATORS),
    boosters: Mapping[str, float] | None = None,
) -> DataFrame:
    """``msg_id, valence`` by a lexicon table (``word, valence``) of any size.

    The same rule as ``valence_sum``, with the lookup as a join on the word.  A lexicon of up to ``MOST_WORDS`` is
    broadcast in parts of ``PART_WORDS``, so the words are looked up where they are and one sum for each message is moved.
    Beyond that words are joined by a shuffle: those that the table may hold, by a bitmap of bounded size, each with its
    booster and negation, and equal ones of a message counted before the join.  A word that
    the table repeats counts with its greatest valence; messages without a lexicon word have no row.
    """
    boosters = fixed.SENTIMENT_BOOSTERS if boosters is None else boosters
    boost = _dictionary(boosters) if boosters else (lambda word: F.lit(None).cast("double"))
    negator_list = F.array(*[F.lit(n) for n in negators])
    words, i = F.col("words"), F.col("at")
    back = F.slice(words, F.greatest(i - (fixed.SENTIMENT_LOOKBACK - 1), F.lit(1)), F.least(i, F.lit(fixed.SENTIMENT_LOOKBACK)))
    context = {"step": F.coalesce(boost(F.get(words, i - 1)), F.lit(0.0)), "negated": F.arrays_overlap(back, negator_list)}

    known = written(lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.max("valence").cast("double").alias("v")), "lexicon")
    n = known.count()
    # outer: else Spark tests the array's size first, below the projections, and repeats the text work for it
    seen = messages.select("msg_id", tokens(F.lower("text")).alias("words")).select(
        "*", F.posexplode_outer("words").alias("at", "word")).where(F.col("word").isNotNull())
    if n <= MOST_WORDS:
        parts = max(1, -(-n // PART_WORDS))
        part = F.pmod(F.xxhash64("word"), F.lit(parts))
        for k in range(parts):
            own = known.where(part == k).withColumnRenamed("v", f"v{k}").withColumn(f"in{k}", F.lit(True))
            seen = seen.join(F.broadcast(own), "word", "left")
        seen = seen.where(F.coalesce(*[f"in{k}" for k in range(parts)])).withColumn(
            "v", F.coalesce(*[f"v{k}" for k in range(parts)])).withColumns(context).withColumn("n", F.lit(1))
    else:
        bits = bitmap.build(known.select(F.xxhash64("word").alias("key")))
        seen = seen.where(bitmap.may_hold(bits, F.xxhash64("word"))).withColumns(context).groupBy(
            "msg_id", "word", "step", "negated").agg(F.count(F.lit(1)).alias("n")).join(known, "word")
    value = F.col("v") + F.signum("v") * F.col("step")
    turned = F.when(F.col("negated"), value * F.lit(fixed.SENTIMENT_NEGATION_FACTOR)).otherwise(value)
    return seen.groupBy("msg_id").agg(F.sum(turned * F.col("n")).alias("valence"))


def compound(total: Column) -> Column:
    """Squeeze a valence sum to [-1, 1] by ``s / sqrt(s*s + alpha)``.

    Give it a column, not an expression: it is used three times.
    """
    return total / F.sqrt(total * total + F.lit(fixed.SENTIMENT_ALPHA))
