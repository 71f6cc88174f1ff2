"""The scoring chain in DuckDB SQL, built from the same fixed values.

Each constant is a common table expression; queries list the ones they need.
"""
from __future__ import annotations

from tellsign import fixed
from tellsign.functions.text import WORD  # noqa: F401  (documents the shared word class)

_W = r"[^\p{L}\p{N}_]"
_GAP = r"[\s\p{Z}\x{1c}-\x{1f}\x{0b}\x{85}]+"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _chars(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in value)


WS = "(" + _chars(fixed.WHITESPACE) + ")"


def strip(expr: str) -> str:
    return f"trim(coalesce({expr}, ''), {WS})"


def planted_text(key: str, text: str) -> str:
    phrases = ", ".join(lit(p) for p in fixed.PLANTED_PHRASES)
    return f"([{phrases}])[({key} % {len(fixed.PLANTED_PHRASES)}) + 1] || coalesce({text}, '')"


def cleaned(source: str) -> str:
    """Strip, drop empty, deduplicate ``source`` (msg_id, user, text)."""
    return f"""
    SELECT min(msg_id) AS msg_id, "user", text, length(text)::INTEGER AS text_length
    FROM (SELECT msg_id, {strip('"user"')} AS "user", {strip('text')} AS text FROM {source})
    WHERE "user" <> '' AND text <> '' GROUP BY "user", text"""


def _doubled(text: str) -> str:
    # RE2 has no lookaround: doubled separators give every word its own pair of them.
    return f"(' ' || regexp_replace({text}, '({_W})', '\\1\\1', 'g') || ' ')"


def pattern_hits(doubled: str, family: str) -> str:
    gap = _GAP
    body = "|".join(gap.join(p.split(" ")) for p in fixed.PATTERNS[family])
    return f"len(regexp_extract_all({doubled}, '{_W}(?:{body}){_W}', 0, 'i'))"


def keyword_hits(doubled_lower: str, family: str) -> str:
    parts = []
    for keyword in fixed.KEYWORDS[family]:
        body = keyword.replace(" ", "  ")
        parts.append(f"len(regexp_extract_all({doubled_lower}, '{_W}{body}{_W}'))")
    return "(" + " + ".join(parts) + ")"


def hits(source: str) -> str:
    res = ", ".join(f"{pattern_hits('_d', f)} AS re_{f}" for f in fixed.PATTERNS)
    kws = ", ".join(f"{keyword_hits('_l', f)} AS kw_{f}" for f in fixed.KEYWORDS)
    return f"""
    SELECT * EXCLUDE (_d, _l), {res}, {kws}
    FROM (SELECT *, {_doubled('text')} AS _d, {_doubled('lower(text)')} AS _l FROM {source})"""


def sentiment(source: str, table: str | None = None) -> str:
    """(msg_id, sentiment) of every message of ``source``; ``table`` is a lexicon (w, v)."""
    lexicon = "(VALUES " + ", ".join(
        f"({lit(w)}, {float(v)!r}::DOUBLE)" for w, v in fixed.SENTIMENT_LEXICON.items()) + ")"
    boost = ", ".join(f"({lit(w)}, {float(v)!r}::DOUBLE)" for w, v in fixed.SENTIMENT_BOOSTERS.items())
    neg = ", ".join(lit(w) for w in fixed.SENTIMENT_NEGATORS)
    return f"""
    SELECT msg_id, s / sqrt(s * s + {fixed.SENTIMENT_ALPHA}) AS sentiment FROM (
      SELECT t.msg_id, sum((lex.v + sign(lex.v) * coalesce(boost.v, 0.0::DOUBLE)) * CASE WHEN
          list_has_any(words[greatest(i - {fixed.SENTIMENT_LOOKBACK}, 1):i - 1], [{neg}])
          THEN {fixed.SENTIMENT_NEGATION_FACTOR}::DOUBLE ELSE 1.0::DOUBLE END) AS s
      FROM (
        SELECT msg_id, words, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (
          SELECT msg_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+') AS words
          FROM {source})) t
      JOIN {table or lexicon} AS lex(w, v) ON lex.w = t.w
      LEFT JOIN (VALUES {boost}) AS boost(w, v)
        ON t.i > 1 AND boost.w = t.words[greatest(t.i - 1, 1)]
      GROUP BY t.msg_id)"""


def features(clean: str, hit: str, sent: str, embeddings: str | None = "embeddings") -> str:
    merged = ", ".join(
        f"greatest(re_{f}, kw_{f})::DOUBLE AS {f}_score"
        for f in ("urgency", "social_proof", "reciprocity", "commitment", "liking", "fear")
    )
    semantic = "0.0::DOUBLE"
    join = ""
    if embeddings:
        semantic = (
            "coalesce(least(greatest(list_sum(list_transform(e.embedding, lambda x: "
            "abs(x::DOUBLE))) / nullif(sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 0) "
            "/ sqrt(greatest(len(e.embedding), 1)::DOUBLE), 0.0), 1.0), 0.0)"
        )
        join = f"LEFT JOIN {embeddings} e ON e.vec_id = h.msg_id"
    return f"""
    SELECT h.msg_id, h."user", h.text, h.text_length,
      CASE WHEN b.hi = b.lo THEN 0.0::DOUBLE
           ELSE (h.text_length - b.lo)::DOUBLE / (b.hi - b.lo)::DOUBLE END AS text_length_signal,
      {merged}, re_authority::DOUBLE AS authority_score, kw_trust::DOUBLE AS trust_score,
      kw_urgency::DOUBLE AS analyzer_urgency_score,
      coalesce(s.sentiment, 0.0) AS sentiment,
      abs(coalesce(s.sentiment, 0.0)) AS sentiment_risk_signal,
      {semantic} AS semantic_signal
    FROM {hit} h
    CROSS JOIN (SELECT min(text_length) AS lo, max(text_length) AS hi FROM {clean}) b
    LEFT JOIN {sent} s ON s.msg_id = h.msg_id {join}"""


def unit(feature: str) -> str:
    floor0 = f"greatest({feature}, 0.0::DOUBLE)"
    if feature in fixed.COUNT_FEATURES:
        return f"(1.0::DOUBLE - exp(-{floor0}))"
    return f"least({floor0}, 1.0::DOUBLE)"


def band(score: str) -> str:
    whens = " ".join(
        f"WHEN {score} >= {lo} AND {score} < {hi} THEN '{name}'" for name, lo, hi in fixed.BANDS
    )
    return f"CASE {whens} END"


def scored(feats: str, weights: dict[str, float] | None = None) -> str:
    weights = fixed.DEFAULT_WEIGHTS if weights is None else weights
    contribs = ", ".join(f"{unit(f)} * {w!r}::DOUBLE AS contrib_{f}" for f, w in weights.items())
    raw = " + ".join(["0.0::DOUBLE", *[f"contrib_{f}" for f in weights]])
    best = "greatest(" + ", ".join(f"contrib_{f}" for f in weights) + ")"
    driver = "CASE " + " ".join(f"WHEN contrib_{f} = {best} THEN '{f}'" for f in weights) + " END"
    total = float(sum(weights.values()))
    return f"""
    SELECT *, {band('risk_score')} AS risk_band FROM (
      SELECT *, least(greatest(risk_raw / {total!r}::DOUBLE, 0.0), 1.0) AS risk_score,
        {driver} AS top_risk_driver
      FROM (SELECT *, {raw} AS risk_raw FROM (SELECT *, {contribs} FROM {feats})))"""


def label(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.FEATURE_LABELS.items())
    return f"CASE {expr} {whens} ELSE {expr} END"


PLANTED = f"""planted AS (
    SELECT doc_id AS msg_id, source AS "user", {planted_text('doc_id', 'text')} AS text
    FROM documents)"""
CLEAN = PLANTED + f""",
clean AS MATERIALIZED ({cleaned('planted')})"""
HITS = CLEAN + f""",
hits AS MATERIALIZED ({hits('clean')})"""
SENT = CLEAN + f""",
sent AS MATERIALIZED ({sentiment('clean')})"""
FEATURES = HITS + f""",
sent AS MATERIALIZED ({sentiment('clean')}),
feats AS MATERIALIZED ({features('clean', 'hits', 'sent')})"""
RESULTS = FEATURES + f""",
res AS MATERIALIZED ({scored('feats')})"""


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
