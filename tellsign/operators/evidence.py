"""Which phrase was found how often in which message."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellsign.fixed import KEYWORDS, PATTERNS
from tellsign.functions import text as T


def _owners(kind: str, table: dict[str, list[str]]) -> Column:
    """A map from each phrase to the families that list it, as rows of one kind."""
    owners: dict[str, list[str]] = {}
    for family, phrases in table.items():
        for p in phrases:
            owners.setdefault(p, []).append(family)
    return F.create_map(*[x for p, families in owners.items() for x in (
        F.lit(p), F.array(*[F.struct(F.lit(f).alias("family"), F.lit(kind).alias("kind")) for f in families]))])


def _rows(found: Column, kind: str, table: dict[str, list[str]]) -> Column:
    """One row for each family and different phrase among the found ones."""
    owners = _owners(kind, table)

    def of(phrase: Column) -> Column:
        hits = F.size(F.filter(found, lambda x: x == phrase))
        return F.transform(F.try_element_at(owners, phrase), lambda o: F.struct(
            o["family"].alias("family"), o["kind"].alias("kind"), phrase.alias("phrase"), hits.alias("hits")))

    return F.flatten(F.array_compact(F.transform(F.array_distinct(found), of)))


def _exact_keywords(lowered: Column) -> Column:
    """Keyword rows of a text by one constant pattern each, for letters that ``folded`` equates."""
    return F.array(*[
        F.struct(F.lit(family).alias("family"), F.lit("keyword").alias("kind"), F.lit(p).alias("phrase"),
                 F.regexp_count(lowered, F.lit(T.phrase_regex([p], " "))).alias("hits"))
        for family, phrases in KEYWORDS.items() for p in phrases])


def hit_evidence(messages: DataFrame) -> DataFrame:
    """One row per message and built-in phrase with its number of hits; row-local, no shuffle.

    One pass over the text finds all phrases; that array says which were found how often.
    """
    df = messages.withColumns({"_low": T.lowered(F.col("text")), "_fold": T.folded(F.col("text"))})
    df = df.withColumn("_found", T.found_phrases(F.col("_fold")))
    df = df.withColumn("_plain", T.plain_gaps(F.col("_found")))
    keywords = F.when(F.col("_low") == F.col("_fold"), _rows(F.col("_found"), "keyword", KEYWORDS)).otherwise(
        _exact_keywords(F.col("_low")))
    rows = df.withColumn("_rows", F.concat(_rows(F.col("_plain"), "regex", PATTERNS), keywords))
    # outer: else Spark tests the array's size first, below the projections, and repeats the text work for it
    return rows.select("msg_id", F.inline_outer("_rows")).filter(F.col("hits") > 0)
