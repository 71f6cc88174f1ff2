"""The scoring job: messages in, features and results out."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellsign.functions import scoring as SC
from tellsign.functions import signals as SG
from tellsign.operators import clean as C
from tellsign.operators import phrases as P
from tellsign.sources import embeddings as E

FEATURE_COLUMNS = [
    "msg_id", "user", "text", "text_length", "text_length_signal",
    "urgency_score", "authority_score", "social_proof_score", "reciprocity_score",
    "commitment_score", "liking_score", "fear_score", "trust_score",
    "analyzer_urgency_score", "sentiment", "sentiment_risk_signal", "semantic_signal",
]


def feature_columns(df: DataFrame) -> list[str]:
    """The features of a table in their order; scores of added phrase families come last."""
    known = [c for c in FEATURE_COLUMNS if c in df.columns]
    added = [c for c in df.columns if c.endswith("_score") and c not in known and c != "risk_score" and not c.startswith("contrib_")]
    return known + added


def row_signals(
    messages: DataFrame,
    lexicon: Mapping[str, float] | DataFrame | None = None,
    analyzer: bool = True,
    phrases: DataFrame | None = None,
) -> DataFrame:
    """Every signal of the text; shared by batch and streams.

    The built-in word lists and a literal lexicon need nothing but the row.  A phrase table is
    joined (batches only) and takes the place of the word lists; without analyzer only its ``regex`` rows count.
    """
    if phrases is None:
        df, scores = SG.with_hit_counts(messages, analyzer), SG.merged_scores(analyzer)
    else:
        phrases = P.prepared(phrases)
        names = P.families(phrases, SG.KINDS if analyzer else ["regex"])
        df, scores = P.with_hit_counts(messages, phrases, names), SG.table_scores(names)
    counts = [c for c in df.columns if c not in messages.columns]
    df = SG.sentiment_columns(df.withColumns(scores).drop(*counts), lexicon, analyzer)
    return df if "semantic_signal" in df.columns else df.withColumn("semantic_signal", F.lit(0.0))


def build_features(
    raw: DataFrame,
    embeddings: DataFrame | None = None,
    lexicon: Mapping[str, float] | DataFrame | None = None,
    analyzer: bool = True,
    phrases: DataFrame | None = None,
    unique: bool = False,
) -> DataFrame:
    """Clean a batch and add all signals.

    The batch is read twice: once narrow (digest, key, length) for duplicates and length
    bounds, once whole, and the texts stay where they are read.  Only vectors of more messages than can be
    broadcast move them, once, by ``msg_id``.  ``unique`` rows (``with_message_id``) are not looked through for duplicates.
    """
    if unique:
        df = C.valid_messages(raw).withColumn("text_length", F.length("text"))
        bounds = C.length_bounds(df)
    else:
        keys = C.message_keys(C.valid_messages(raw))
        bounds, df = C.length_bounds(keys), C.clean_messages(raw, keys)
    if embeddings is not None and phrases is None:
        df = E.attach(df, embeddings)
    df = row_signals(df, lexicon, analyzer, phrases)
    if embeddings is not None and phrases is not None:  # the texts are read in parts for a large table, so vectors come last
        df = E.attach(df.drop("semantic_signal"), embeddings)
    df = df.withColumn(
        "text_length_signal",
        SG.length_signal(
            F.col("text_length"),
            bounds.select("shortest").scalar(), bounds.select("longest").scalar(),
        ),
    )
    return df.select(*feature_columns(df))


def score_features(
    features: DataFrame, weights: Mapping[str, float] | None = None, explain: bool = True
) -> DataFrame:
    """Score stored or fresh features; no text work, so rescoring is cheap."""
    return SC.with_risk_band(SC.score(features, weights, explain))


def score_batch(
    raw: DataFrame,
    embeddings: DataFrame | None = None,
    weights: Mapping[str, float] | None = None,
    lexicon: Mapping[str, float] | DataFrame | None = None,
    phrases: DataFrame | None = None,
    unique: bool = False,
) -> DataFrame:
    return score_features(build_features(raw, embeddings, lexicon, phrases=phrases, unique=unique), weights)


def rescore(features: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """What-if scores with other weights; features left out of the weights do not count."""
    from tellsign.sources.weights import validate_update

    return score_features(features, validate_update(weights))
