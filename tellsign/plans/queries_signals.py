"""Queries over cleaning, signals and scores."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.functions import scoring as SC
from tellsign.functions import sentiment as S
from tellsign.functions import signals as SG
from tellsign.functions import text as T
from tellsign.operators import clean as C
from tellsign.operators import evidence as EV
from tellsign.operators import phrases as PH
from tellsign.plans import oracle_base as O
from tellsign.plans.catalog import features, fresh_features, query, results
from tellsign.operators.filters import of_user
from tellsign.plans.scoring import rescore, score_batch, score_features
from tellsign.sources import embeddings as EM
from tellsign.sources.embeddings import stored_embeddings
from tellsign.sources.lexicons import fixed_phrases
from tellsign.sources.tables import conversation_messages, planted_messages, table


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def r6_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("message_clean", O.q(O.CLEAN, 'SELECT msg_id, "user", text, text_length FROM clean'))
def message_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = C.clean_messages(planted_messages(spark, sf_dir))
    return clean.select("msg_id", "user", "text", "text_length")


_CONVERSATIONS = f"""conv AS (
    SELECT conv_id || '/' || turn AS msg_id, role || conv_id AS "user", text FROM conversations),
cc AS ({O.cleaned('conv')})"""


@query("conversation_clean", O.q(_CONVERSATIONS, """
    SELECT "user", count(*) AS messages, sum(text_length)::BIGINT AS characters,
           min(msg_id) AS first_id FROM cc GROUP BY "user" """))
def conversation_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = C.clean_messages(conversation_messages(spark, sf_dir))
    return clean.groupBy("user").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("text_length").alias("characters"),
        F.min("msg_id").alias("first_id"),
    )


@query("cleaning_report", O.q(O.PLANTED + f""", stripped AS (
    SELECT {O.strip('"user"')} AS "user", {O.strip('text')} AS text FROM planted),
  k AS (SELECT count(*) AS n FROM (
    SELECT DISTINCT "user", text FROM stripped WHERE "user" <> '' AND text <> ''))""", """
    SELECT count(*) AS loaded,
           count(*) FILTER (WHERE "user" = '' OR text = '') AS empty_dropped,
           count(*) FILTER (WHERE "user" <> '' AND text <> '') - max(k.n) AS duplicates_removed,
           max(k.n) AS kept
    FROM stripped, k"""))
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cleaning_report(planted_messages(spark, sf_dir))


_BLANKED = """batches AS (
    SELECT msg_id % 50 AS batch, "user", CASE WHEN length(text) % 2 = 0 THEN text ELSE ' ' END AS text FROM planted)"""


@query("batch_status", O.q(O.PLANTED + ", " + _BLANKED, f"""
    SELECT batch, count(*) AS loaded, count(*) FILTER ({O.strip('text')} <> '' AND {O.strip('"user"')} <> '') AS kept,
      count(*) FILTER ({O.strip('text')} <> '' AND {O.strip('"user"')} <> '') > 0 AS usable FROM batches GROUP BY batch"""))
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty batches, in which half of the texts are blank: which of them can be scored."""
    blank = F.when(F.length("text") % 2 == 0, F.col("text")).otherwise(" ")
    rows = planted_messages(spark, sf_dir).withColumn("text", blank).withColumn("batch", F.col("msg_id") % 50)
    return C.batch_status(rows, "batch")


_TOKENS = ", ".join(O.lit(t) for t in fixed.NULL_TOKENS)


def _with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second message loses its text to one of the null tokens."""
    tokens = F.array(*[F.lit(t) for t in fixed.NULL_TOKENS])
    slot = (F.col("msg_id") % len(fixed.NULL_TOKENS)).cast("int")
    text = F.when(F.col("msg_id") % 2 == 1, F.get(tokens, slot)).otherwise(F.col("text"))
    return planted_messages(spark, sf_dir).withColumn("text", text)


@query("null_token_drop", O.q(O.PLANTED + f""", tok AS (
    SELECT msg_id, "user", CASE WHEN msg_id % 2 = 1
      THEN ([{_TOKENS}])[(msg_id % {len(fixed.NULL_TOKENS)}) + 1] ELSE text END AS text
    FROM planted),
  nulled AS (SELECT msg_id, "user", CASE WHEN text NOT IN ({_TOKENS}) THEN text END AS text FROM tok)
  """, f"""SELECT msg_id, {O.strip('"user"')} AS "user", length({O.strip('text')})::INTEGER AS n
  FROM nulled WHERE {O.strip('text')} <> '' AND {O.strip('"user"')} <> '' """))
def null_token_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.valid_messages(C.drop_null_tokens(_with_tokens(spark, sf_dir)))
    return rows.select("msg_id", "user", F.length("text").alias("n"))


@query("text_length_signal", O.q(O.CLEAN, """
    SELECT msg_id, text_length, round(CASE WHEN hi = lo THEN 0.0::DOUBLE
           ELSE (text_length - lo)::DOUBLE / (hi - lo)::DOUBLE END, 6) AS text_length_signal
    FROM clean, (SELECT min(text_length) AS lo, max(text_length) AS hi FROM clean)"""))
def text_length_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = C.distinct_keys(C.message_keys(C.valid_messages(planted_messages(spark, sf_dir))))
    bounds = C.length_bounds(keys)
    signal = SG.length_signal(
        F.col("text_length"), bounds.select("shortest").scalar(), bounds.select("longest").scalar())
    return keys.select("msg_id", "text_length", F.round(signal, 6).alias("text_length_signal"))


_RE = [f"re_{f}" for f in fixed.PATTERNS]
_KW = [f"kw_{f}" for f in fixed.KEYWORDS]


@query("regex_hits", O.q(O.HITS, "SELECT msg_id, " + ", ".join(
    f"{c}::INTEGER AS {c}" for c in _RE) + " FROM hits"))
def regex_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.with_hit_counts(C.clean_messages(planted_messages(spark, sf_dir))).select(
        "msg_id", *_RE)


@query("keyword_hits", O.q(O.HITS, "SELECT msg_id, " + ", ".join(
    f"{c}::INTEGER AS {c}" for c in _KW) + " FROM hits"))
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.with_hit_counts(C.clean_messages(planted_messages(spark, sf_dir))).select(
        "msg_id", *_KW)


_SCORES = [c for c in fixed.COUNT_FEATURES] + ["analyzer_urgency_score"]


@query("merged_signals", O.q(O.FEATURES, f"SELECT msg_id, {', '.join(_SCORES)} FROM feats"))
def merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh_features(spark, sf_dir).select("msg_id", *_SCORES)


@query("fallback_signals", O.q(O.HITS, "SELECT msg_id, " + ", ".join(
    f"re_{f}::DOUBLE AS {f}_score" for f in fixed.PATTERNS) + """, 0.0::DOUBLE AS trust_score, 0.0::DOUBLE AS sentiment,
    0.0::DOUBLE AS sentiment_risk_signal FROM hits"""))
def fallback_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a run without keyword lists and sentiment."""
    from tellsign.plans.scoring import build_features

    df = build_features(planted_messages(spark, sf_dir), analyzer=False)
    return df.select("msg_id", *[f"{f}_score" for f in fixed.PATTERNS], "trust_score",
                     "sentiment", "sentiment_risk_signal")


@query("semantic_signal", O.q(O.FEATURES, f"SELECT msg_id, {r6_sql('semantic_signal')} FROM feats"))
def semantic_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh_features(spark, sf_dir).select("msg_id", *r6("semantic_signal"))


@query("embedding_normalize", """
    SELECT msg_id, i::INTEGER AS i, round(x / nullif(norm, 0), 6) AS value FROM (
      SELECT vec_id AS msg_id, unnest(embedding)::DOUBLE AS x,
             generate_subscripts(embedding, 1) - 1 AS i,
             sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm
      FROM embeddings)""")
def embedding_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = stored_embeddings(spark, sf_dir).select(
        "msg_id", SG.unit_vector(F.col("embedding")).alias("u"))
    return unit.select("msg_id", F.posexplode("u").alias("i", "x")).select(
        "msg_id", "i", F.round("x", 6).alias("value"))


def _letter_model():
    """An encoder for queries: how often four letters occur, and the length."""
    def predict(texts):
        return np.array([[t.count("a"), t.count("e"), t.count("n"), t.count("t"), len(t)] for t in texts], dtype=np.float32)

    return predict


@query("encoder_signal", O.q(O.CLEAN, """
    SELECT msg_id, round((a + e + n + t + l) / sqrt(a * a + e * e + n * n + t * t + l * l) / sqrt(5::DOUBLE), 4) AS semantic_signal
    FROM (SELECT msg_id, """ + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS {c}" for c in "aent") + """,
      length(text)::DOUBLE AS l FROM clean)"""))
def encoder_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semantic signal from an encoder that runs once for each different text."""
    clean = C.clean_messages(planted_messages(spark, sf_dir))
    vectors = EM.encode_distinct(clean, _letter_model)
    return EM.attach(clean, vectors).select("msg_id", F.round("semantic_signal", 4).alias("semantic_signal"))


@query("lexicon_sentiment", O.q(O.SENT, """
    SELECT c.msg_id, round(coalesce(s.sentiment, 0.0), 6) AS sentiment,
           round(abs(coalesce(s.sentiment, 0.0)), 6) AS sentiment_risk_signal
    FROM clean c LEFT JOIN sent s ON s.msg_id = c.msg_id"""))
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = SG.sentiment_columns(C.clean_messages(planted_messages(spark, sf_dir)))
    return df.select("msg_id", *r6("sentiment", "sentiment_risk_signal"))


@query("sentiment_table", O.q(O.CLEAN + f""",
  lex AS MATERIALIZED (SELECT w, (len(w) % 9 - 4) / 2.0::DOUBLE AS v FROM (SELECT DISTINCT unnest(
    regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+')) AS w FROM conversations)),
  sent AS MATERIALIZED ({O.sentiment('clean', 'lex')})""", """
    SELECT c.msg_id, round(coalesce(s.sentiment, 0.0), 6) AS sentiment,
           round(abs(coalesce(s.sentiment, 0.0)), 6) AS sentiment_risk_signal
    FROM clean c LEFT JOIN sent s ON s.msg_id = c.msg_id"""))
def sentiment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment by a large lexicon table: all words of the conversations, with a valence made from their lengths."""
    words = table(spark, sf_dir, "conversations").select(F.explode(S.tokens(F.lower("text"))).alias("word")).distinct()
    lexicon = words.withColumn("valence", (F.length("word") % 9 - 4) / 2)
    df = SG.sentiment_columns(C.clean_messages(planted_messages(spark, sf_dir)), lexicon)
    return df.select("msg_id", *r6("sentiment", "sentiment_risk_signal"))


@query("missing_feature", O.q(
    O.FEATURES + ", part AS (SELECT * REPLACE (0.0::DOUBLE AS trust_score, 0.0::DOUBLE AS semantic_signal) FROM feats), "
    f"r2 AS ({O.scored('part')})", f"SELECT msg_id, {r6_sql('risk_score')}, top_risk_driver, risk_band FROM r2"))
def missing_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that a table lacks count as zero."""
    part = features(spark, sf_dir).drop("trust_score", "semantic_signal")
    return score_features(part).select("msg_id", *r6("risk_score"), "top_risk_driver", "risk_band")


@query("user_point", O.q(O.RESULTS, f"""
    SELECT msg_id, "user", {r6_sql('risk_score')}, risk_band FROM res WHERE "user" = 'src1' """))
def user_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_user(results(spark, sf_dir), "src1").select("msg_id", "user", *r6("risk_score"), "risk_band")


@query("unit_signals", O.q(O.FEATURES, "SELECT msg_id, " + ", ".join(
    f"round({O.unit(f)}, 6) AS {f}" for f in fixed.FEATURES) + " FROM feats"))
def unit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select(
        "msg_id",
        *[F.round(SC.unit_value(F.col(f), f), 6).alias(f) for f in fixed.FEATURES])


@query("risk_scores", O.q(O.RESULTS, f'SELECT msg_id, "user", {r6_sql("risk_raw", "risk_score")} FROM res'))
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("msg_id", "user", *r6("risk_raw", "risk_score"))


_CONTRIB = [f"contrib_{f}" for f in fixed.FEATURES]


@query("risk_contributions", O.q(O.RESULTS, f"SELECT msg_id, {r6_sql(*_CONTRIB)} FROM res"))
def risk_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("msg_id", *r6(*_CONTRIB))


@query("top_driver", O.q(O.RESULTS, f"""
    SELECT msg_id, top_risk_driver, {O.label('top_risk_driver')} AS label FROM res"""))
def top_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select(
        "msg_id", "top_risk_driver", SC.feature_label(F.col("top_risk_driver")).alias("label"))


@query("risk_band", O.q(O.RESULTS, "SELECT msg_id, risk_band FROM res"))
def risk_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("msg_id", "risk_band")


_CUSTOM = {"fear_score": 0.3, "urgency_score": 0.2, "authority_score": 0.1,
           "semantic_signal": 0.05, "text_length_signal": 0.05, "sentiment_risk_signal": 0.1,
           "trust_score": 0.1, "social_proof_score": 0.02, "reciprocity_score": 0.02,
           "commitment_score": 0.02, "liking_score": 0.04}
_SUBSET = {"trust_score": 1.0, "urgency_score": 2.0}


def _rescored_sql(weights: dict) -> str:
    return O.q(O.FEATURES + f", r2 AS ({O.scored('feats', weights)})", """
        SELECT msg_id, round(risk_score, 6) AS risk_score, top_risk_driver, risk_band FROM r2""")


@query("rescore_weights", _rescored_sql(_CUSTOM))
def rescore_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescore(features(spark, sf_dir), _CUSTOM).select(
        "msg_id", *r6("risk_score"), "top_risk_driver", "risk_band")


@query("rescore_subset", _rescored_sql(_SUBSET))
def rescore_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescore(features(spark, sf_dir), _SUBSET).select(
        "msg_id", *r6("risk_score"), "top_risk_driver", "risk_band")


@query("html_escape", """
    SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
           '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", T.html_escape(F.col("html")).alias("escaped"))


@query("text_fingerprint", O.q(O.CLEAN, """
    SELECT msg_id, sha256(text) AS digest, substr(sha1("user" || chr(10) || text), 1, 16) AS item_id
    FROM clean"""))
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellsign.functions.triage import message_id

    clean = C.clean_messages(planted_messages(spark, sf_dir))
    return clean.select(
        "msg_id", T.fingerprint(F.col("text")).alias("digest"),
        message_id(F.col("user"), F.col("text")).alias("item_id"))


def _evidence_sql() -> str:
    doubled, low = O._doubled("text"), O._doubled("lower(text)")
    parts = []
    for kind, table_, src, gap, flag in (
            ("regex", fixed.PATTERNS, "_d", O._GAP, ", 0, 'i'"),
            ("keyword", fixed.KEYWORDS, "_l", "  ", "")):
        for family, phrases in table_.items():
            for p in phrases:
                body = gap.join(p.split(" "))
                parts.append(
                    f"SELECT msg_id, '{family}' AS family, '{kind}' AS kind, {O.lit(p)} AS phrase, "
                    f"len(regexp_extract_all({src}, '{O._W}{body}{O._W}'{flag}))::INTEGER AS hits "
                    f"FROM padded")
    union = " UNION ALL ".join(parts)
    return O.q(O.CLEAN + f", padded AS MATERIALIZED (SELECT msg_id, {doubled} AS _d, {low} AS _l FROM clean)",
               f"SELECT * FROM ({union}) WHERE hits > 0")


@query("hit_evidence", _evidence_sql())
def hit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.hit_evidence(C.clean_messages(planted_messages(spark, sf_dir)))


def _runs_sql(words: str, n: int) -> str:
    return " || ' ' || ".join(f"{words}[i + {k}]" for k in range(n))


# A phrase table from the conversations: their single words and pairs as patterns, their runs of three as keywords.
_PHRASE_TABLE = f"""turns AS MATERIALIZED (
    SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM conversations),
  phrases AS MATERIALIZED (
    SELECT DISTINCT family, kind, phrase, len(phrase) AS ord FROM (
      SELECT CASE WHEN len(w[i]) > 6 THEN 'jargon' ELSE 'urgency' END AS family, 'regex' AS kind, w[i] AS phrase
        FROM turns, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE len(w[i]) > 5
      UNION ALL SELECT 'pairs', 'regex', {_runs_sql('w', 2)}
        FROM turns, LATERAL (SELECT unnest(range(1, len(w))) AS i)
      UNION ALL SELECT 'pairs', 'keyword', {_runs_sql('w', 3)}
        FROM turns, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)))"""

# Both foldings of a text as words with what follows each; the run at each place joined with the phrases.
_PHRASE_HITS = O.CLEAN + ", " + _PHRASE_TABLE + """,
forms AS (
    SELECT msg_id, 'keyword' AS kind, lower(text) AS t FROM clean
    UNION ALL SELECT msg_id, 'regex', replace(replace(lower(replace(text, 'İ', 'i')), 'ı', 'i'), 'ſ', 's') FROM clean),
words AS MATERIALIZED (
    SELECT msg_id, kind, regexp_extract_all(t, '[\\p{L}\\p{N}_]+') AS w,
      regexp_extract_all(t, '[\\p{L}\\p{N}_]+([^\\p{L}\\p{N}_]*)', 1) AS g FROM forms),
runs AS (
    SELECT msg_id, kind, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase, g[i:i + n - 2] AS between
    FROM words, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i), LATERAL (SELECT unnest([1, 2, 3]) AS n)
    WHERE i + n - 1 <= len(w)),
spans AS MATERIALIZED (
    SELECT r.msg_id, p.family, r.kind, p.phrase, p.ord, r.i, r.n FROM runs r JOIN phrases p USING (kind, phrase)
    WHERE CASE WHEN r.kind = 'keyword' THEN len(list_filter(between, lambda x: x <> ' ')) = 0
      ELSE len(list_filter(between, lambda x: NOT regexp_full_match(x, '""" + O._GAP + """'))) = 0 END),
counted AS MATERIALIZED (
    SELECT msg_id, family, kind, alone, list_reduce(
      list_prepend({'i': 0, 'u': 0, 'c': 0}, list({'i': i, 'u': i + n, 'c': 0} ORDER BY i, ord)),
      lambda a, x: CASE WHEN x.i >= a.u THEN {'i': x.i, 'u': x.u, 'c': a.c + 1} ELSE a END).c AS hits
    FROM (SELECT * EXCLUDE (i, n), i::INTEGER AS i, n::INTEGER AS n, CASE WHEN kind = 'keyword' THEN phrase END AS alone FROM spans)
    GROUP BY msg_id, family, kind, alone)"""


def conversation_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words and runs of two and three words of the conversations as phrases, with two families that are new."""
    turns = table(spark, sf_dir, "conversations").select(
        F.regexp_extract_all(F.lower("text"), F.lit(PH.WORD), F.lit(0)).alias("w"))

    def runs(n: int) -> DataFrame:
        places = F.sequence(F.lit(1), F.size("w") - n + 1)
        return turns.where(F.size("w") >= n).select(F.explode(F.transform(
            places, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).alias("phrase"))

    family = F.when(F.length("phrase") > 6, "jargon").otherwise("urgency")
    rows = runs(1).where(F.length("phrase") > 5).select(family.alias("family"), F.lit("regex").alias("kind"), "phrase")
    for n, kind in ((2, "regex"), (3, "keyword")):
        rows = rows.unionByName(runs(n).select(F.lit("pairs").alias("family"), F.lit(kind).alias("kind"), "phrase"))
    return rows.distinct().withColumn("ord", F.length("phrase").cast("long"))


@query("phrase_table_fixed", O.q(O.HITS, "SELECT msg_id, " + ", ".join(f"{c}::INTEGER AS {c}" for c in _RE + _KW) + " FROM hits"))
def phrase_table_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in lists, given as a table."""
    phrases = fixed_phrases(spark)
    clean = C.clean_messages(planted_messages(spark, sf_dir))
    return PH.with_hit_counts(clean, phrases, PH.families(phrases)).select("msg_id", *_RE, *_KW)


@query("phrase_table_hits", O.q(_PHRASE_HITS, """
    SELECT msg_id, family, kind, sum(hits)::BIGINT AS hits FROM counted GROUP BY msg_id, family, kind"""))
def phrase_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of some 10**5 phrases at sf0.01, all families."""
    clean = C.clean_messages(planted_messages(spark, sf_dir))
    return PH.family_hits(clean, conversation_phrases(spark, sf_dir)).select(
        "msg_id", "family", "kind", F.col("hits").cast("long").alias("hits"))


_TABLE_WEIGHTS = {"urgency_score": 0.2, "pairs_score": 0.15, "semantic_signal": 0.12, "fear_score": 0.1, "jargon_score": 0.05}


@query("phrase_table_scores", O.q(_PHRASE_HITS + """,
families AS (SELECT msg_id, family || '_score' AS f, max(hits)::DOUBLE AS s FROM (
    SELECT msg_id, family, kind, sum(hits) AS hits FROM counted GROUP BY ALL) GROUP BY ALL),
wide AS (SELECT c.msg_id, """ + ", ".join(
    f"coalesce(max(s) FILTER (f = '{f}'), 0.0::DOUBLE) AS {f}" for f in ("urgency_score", "pairs_score", "jargon_score", "fear_score"))
    + """, any_value(e.embedding) AS embedding FROM clean c LEFT JOIN families USING (msg_id)
    LEFT JOIN embeddings e ON e.vec_id = c.msg_id GROUP BY c.msg_id),
feats AS (SELECT * EXCLUDE (embedding), coalesce(least(greatest(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE)))
    / nullif(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 0)
    / sqrt(greatest(len(embedding), 1)::DOUBLE), 0.0), 1.0), 0.0) AS semantic_signal FROM wide),
r2 AS (""" + O.scored("feats", _TABLE_WEIGHTS) + ")", f"""
    SELECT msg_id, pairs_score, jargon_score, {r6_sql('risk_score')}, top_risk_driver, risk_band FROM r2"""))
def phrase_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a phrase table: added families are features with weights of their own."""
    scored = score_batch(planted_messages(spark, sf_dir), stored_embeddings(spark, sf_dir), _TABLE_WEIGHTS,
                         phrases=conversation_phrases(spark, sf_dir))
    return scored.select("msg_id", "pairs_score", "jargon_score", *r6("risk_score"), "top_risk_driver", "risk_band")


@query("phrase_table_evidence", O.q(_PHRASE_HITS, """
    SELECT family, kind, phrase, count(*)::BIGINT AS messages, sum(hits)::BIGINT AS hits FROM (
      SELECT msg_id, family, kind, phrase, count(*) AS hits FROM spans WHERE len(phrase) - len(replace(phrase, ' ', '')) < 1
      GROUP BY ALL) GROUP BY family, kind, phrase"""))
def phrase_table_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each single word of the table was found, and in how many messages."""
    words = conversation_phrases(spark, sf_dir).where(~F.contains("phrase", F.lit(" ")))
    found = PH.evidence(C.clean_messages(planted_messages(spark, sf_dir)), words)
    return found.groupBy("family", "kind", "phrase").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("hits").cast("long").alias("hits"))
