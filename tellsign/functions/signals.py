"""The eleven signals of a message as column expressions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellsign.fixed import KEYWORDS, PATTERNS
from tellsign.functions import sentiment as S
from tellsign.functions import text as T

#: Kinds of phrases and the prefixes of their counts.
KINDS = {"regex": "re", "keyword": "kw"}
MERGED = ["urgency", "social_proof", "reciprocity", "commitment", "liking", "fear"]


def with_hit_counts(df: DataFrame, analyzer: bool = True) -> DataFrame:
    """Add ``re_<family>`` for the patterns and ``kw_<family>`` for the keywords.

    One regular expression pass per text finds the phrases of all families; the counts are
    taken from that small array.
    """
    # Columns that are used many times stay separate projections, so each is computed once.
    df = df.withColumns({"_low": T.lowered(F.col("text")), "_fold": T.folded(F.col("text"))})
    df = df.withColumn("_found", T.found_phrases(F.col("_fold")))
    df = df.withColumn("_plain", T.plain_gaps(F.col("_found")))
    counts = {f"re_{f}": T.pattern_count(F.col("_plain"), F.col("_fold"), f) for f in PATTERNS}
    if analyzer:
        counts |= {
            f"kw_{f}": T.keyword_count(F.col("_found"), F.col("_fold"), F.col("_low"), f)
            for f in KEYWORDS
        }
    return df.withColumns(counts).drop("_low", "_fold", "_found", "_plain")


def table_scores(names: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Scores of the families of a phrase table (family, kind): the larger count of both kinds, or the only one."""
    counts: dict[str, list[Column]] = {}
    for family, kind in names:
        counts.setdefault(f"{family}_score", []).append(F.col(f"{KINDS[kind]}_{family}").cast("double"))
    out = {name: F.greatest(*both) if len(both) > 1 else both[0] for name, both in counts.items()}
    if ("urgency", "keyword") in names:
        out["analyzer_urgency_score"] = F.col("kw_urgency").cast("double")
    return out


def merged_scores(analyzer: bool = True) -> dict[str, Column]:
    """The larger of both counts for six families; trust and authority have one source."""
    out: dict[str, Column] = {}
    for family in MERGED:
        patterns = F.col(f"re_{family}").cast("double")
        keywords = F.col(f"kw_{family}").cast("double") if analyzer else F.lit(0.0)
        out[f"{family}_score"] = F.greatest(patterns, keywords)
    out["authority_score"] = F.col("re_authority").cast("double")
    out["trust_score"] = F.col("kw_trust").cast("double") if analyzer else F.lit(0.0)
    if analyzer:
        out["analyzer_urgency_score"] = F.col("kw_urgency").cast("double")
    return out


def length_signal(length: Column, shortest: Column, longest: Column) -> Column:
    """Position between the shortest and the longest message, 0 if all are equally long."""
    span = (longest - shortest).cast("double")
    share = (length - shortest).cast("double") / F.when(span != 0, span)
    return F.coalesce(share, F.lit(0.0))


def _l2(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return ~bad


def unit_vector(vector: Column) -> Column:
    """Scale to length one; vectors that hold NaN or infinity stop the job."""
    # The norm is bound by an outer transform: named in the inner one, it would be worked out for each component.
    scaled = F.get(F.transform(F.array(_l2(vector)), lambda norm: F.transform(
        vector, lambda x: F.try_divide(x.cast("double"), norm))), F.lit(0))
    return F.when(vector.isNull() | finite(vector), scaled).otherwise(
        F.raise_error(F.lit("embedding holds NaN or infinite values")).cast("array<double>")
    )


def semantic_signal(vector: Column) -> Column:
    """L1 norm against its largest value for a unit vector of that size, within [0, 1]."""
    l1 = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    size = F.greatest(F.size(vector), F.lit(1)).cast("double")
    value = F.least(F.greatest(l1 / F.sqrt(size), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(value, F.lit(0.0))


def sentiment_columns(
    df: DataFrame, lexicon: Mapping[str, float] | DataFrame | None = None, analyzer: bool = True
) -> DataFrame:
    """Sentiment by a literal lexicon, row-local, or by a table (``word, valence``) of any size (batches only)."""
    if not analyzer:
        return df.withColumns({"sentiment": F.lit(0.0), "sentiment_risk_signal": F.lit(0.0)})
    if isinstance(lexicon, DataFrame):
        df = df.join(S.valence_sums(df, lexicon), "msg_id", "left")
        df = df.withColumn("valence", F.coalesce("valence", F.lit(0.0)))
        return df.withColumn("sentiment", S.compound(F.col("valence"))).withColumn(
            "sentiment_risk_signal", F.abs("sentiment")).drop("valence")
    df = df.withColumn("_words", S.tokens(T.lowered(F.col("text"))))
    df = df.withColumn("_sum", S.valence_sum(F.col("_words"), lexicon))
    df = df.withColumn("sentiment", S.compound(F.col("_sum"))).drop("_words", "_sum")
    return df.withColumn("sentiment_risk_signal", F.abs("sentiment"))
