"""The registered queries of this folder and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tellsign.llm import (
    decontaminate, divergence, lines, minhash, mixing, neighbours, packing, pii, quality, ranking, secrets, shards, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subword_quality": quality.op1,
    "op2_benchmark_containment": decontaminate.op2,
    "op3_cross_polytope": neighbours.op3,
    "op4_line_chunks": lines.op4,
    "op5_source_mix": mixing.op5,
    "op6_virtual_slots": shards.op6,
    "op7_ftrl_toxicity": toxicity.op7,
    "op8_bootstrapped_pii": pii.op8,
    "op9_markov_secrets": secrets.op9,
    "op10_minhash_groups": minhash.op10,
    "op11_best_fit_packing": packing.op11,
    "op12_max_sketch_ranking": ranking.op12,
    "op13_divergence_audit": divergence.op13,
}

# Word runs as the operators see them: distinct shingles of five words, or the whole sequence.
_SHINGLES = """
{name}_words AS (
  SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
{name}_shingles AS (
  SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g
  FROM {name}_words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0)"""

# An item of fewer than five words is one run, which a document may hold anywhere.
_CONTAINMENT = "WITH " + _SHINGLES.format(name="d", key="doc_id", table="documents") + "," + _SHINGLES.format(
    name="b", key="item_id", table="benchmark") + """,
d_runs AS (
  SELECT DISTINCT id, w[i:i + k - 1] AS g
  FROM d_words, (SELECT DISTINCT len(w) AS k FROM b_words WHERE len(w) BETWEEN 1 AND 4),
    LATERAL (SELECT unnest(range(1, greatest(len(w) - k, 0) + 2)) AS i) WHERE len(w) >= k),
held AS (SELECT * FROM d_shingles UNION SELECT * FROM d_runs),
sizes AS (SELECT id, count(*) AS n FROM b_shingles GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n AS item_shingles, count(*) AS shared, count(*) / n AS containment
FROM b_shingles b JOIN held d USING (g) JOIN sizes s ON s.id = b.id
GROUP BY d.id, b.id, n HAVING count(*) >= 0.8 * n"""

_GROUPS = "WITH RECURSIVE " + _SHINGLES.format(name="d", key="doc_id", table="documents") + """,
sizes AS (SELECT id, count(*) AS n FROM d_shingles GROUP BY id),
links AS (
  SELECT a.id AS u, b.id AS v FROM d_shingles a JOIN d_shingles b ON a.g = b.g AND a.id <> b.id
  JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id
  GROUP BY a.id, b.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION SELECT l.v, reach.r FROM reach JOIN links l ON l.u = reach.id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes ON sizes.id = doc_id
JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = doc_id"""

# Terms are runs of ASCII letters and digits and of all other characters beyond ASCII.
_RANKED = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT DISTINCT 'q', item_id, text FROM benchmark),
terms AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM words),
tf AS (SELECT id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY ALL),
size AS (SELECT id, sum(tf)::BIGINT AS n FROM tf GROUP BY id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
weights AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, corpus GROUP BY term),
scores AS (
  SELECT q.id AS item_id, tf.id AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM (SELECT DISTINCT id, term FROM terms WHERE kind = 'q') q JOIN tf USING (term) JOIN weights USING (term)
    JOIN size ON size.id = tf.id, corpus
  GROUP BY ALL HAVING score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

_DIVERGENCE = """
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(text, '') AS text FROM documents),
hits AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM hits GROUP BY ALL HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM hits SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, sum(coalesce(n, 0))::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN own USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    1 + (1000000000 * (coalesce(o.n, 0) + 1)) // (g.total + v) AS p,
    1 + (1000000000 * (k.n + 1)) // (l.total + v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
    LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, 'pair' AS part, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM shares x JOIN shares y USING (lang, term) GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (
    SELECT lang, source, part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {
    "op2_benchmark_containment": _CONTAINMENT,
    "op10_minhash_groups": _GROUPS,
    "op12_max_sketch_ranking": _RANKED,
    "op13_divergence_audit": _DIVERGENCE,
}
