"""Queries over run history, presets, rules and evaluation."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.operators import charts as CH
from tellsign.operators import evaluate as EV
from tellsign.operators import history as H
from tellsign.operators import kpi as K
from tellsign.plans import oracle_base as O
from tellsign.plans.catalog import query, results
from tellsign.plans.jobs import staged
from tellsign.plans.queries_signals import r6
from tellsign.plans.queries_triage import stamp
from tellsign.session import scratch_dir
from tellsign.sources import presets as PR
from tellsign.sources import store
from tellsign.sources.tables import table
from tellsign.sources.weights import read_weights, weight_frame
from tellsign.streaming import score as ST


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored messages with the hour of the event of the same number as their run."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), hour.alias("timestamp"))
    scored = results(spark, sf_dir).select("msg_id", "user", "risk_score", "risk_band")
    run = F.timestamp_diff("HOUR", F.to_timestamp(F.lit("1970-01-01")), F.col("timestamp"))
    return scored.join(events, "msg_id").withColumn("run_version", run)


def fresh_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kpi_snapshot(runs(spark, sf_dir), ["run_version", "timestamp"])


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored timeline, as runs would have appended it."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings", "events")]
    return staged(spark, "timeline", inputs,
                  lambda path: fresh_timeline(spark, sf_dir).write.parquet(path))


_RUNS = O.RESULTS + """,
runs AS MATERIALIZED (
  SELECT r.*, (epoch(date_trunc('hour', e.ts)) / 3600)::BIGINT AS run_version, date_trunc('hour', e.ts) AS ts
  FROM res r JOIN events e ON e.event_id = r.msg_id),
tl AS MATERIALIZED (
  SELECT run_version, ts AS "timestamp", count(*) AS messages, count(DISTINCT "user") AS users,
    round(avg(risk_score), 4) AS avg_risk, round(max(risk_score), 4) AS max_risk,
    round(median(risk_score), 4) AS median_risk, count(*) FILTER (WHERE risk_band = 'High') AS high,
    count(*) FILTER (WHERE risk_band = 'Medium') AS medium, count(*) FILTER (WHERE risk_band = 'Low') AS low,
    round(count(*) FILTER (WHERE risk_band = 'High') / count(*)::DOUBLE * 100, 1) AS high_pct
  FROM runs GROUP BY run_version, ts)"""
_TL = """run_version, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", messages, users, avg_risk,
  max_risk, median_risk, high, medium, low, high_pct"""
_TL_COLUMNS = ["run_version", "messages", "users", "avg_risk", "max_risk", "median_risk", "high",
               "medium", "low", "high_pct"]


@query("kpi_timeline", O.q(_RUNS, f"SELECT {_TL} FROM tl"))
def kpi_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh_timeline(spark, sf_dir).select(*_TL_COLUMNS, stamp("timestamp"))


@query("kpi_tail", O.q(_RUNS, f"SELECT {_TL} FROM tl ORDER BY run_version DESC LIMIT 7"))
def kpi_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = H.tail_of_log(timeline(spark, sf_dir), "run_version", 7)
    return last.select(*_TL_COLUMNS, stamp("timestamp"))


@query("kpi_trim", O.q(_RUNS, f"SELECT {_TL} FROM tl ORDER BY run_version DESC LIMIT {fixed.KPI_TIMELINE_MAX}"))
def kpi_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log appended twice (the second time adds nothing) and cut to the entries that are kept."""
    path = scratch_dir(spark, "kpi-log")
    for _ in range(2):
        store.append_log(timeline(spark, sf_dir), f"{path}/log", "run_version")
    kept = store.trim_log(spark, f"{path}/log", f"{path}/trimmed", "run_version", fixed.KPI_TIMELINE_MAX)
    return kept.select(*_TL_COLUMNS, stamp("timestamp"))


@query("kpi_delta", O.q(_RUNS, "SELECT run_version, messages, avg_risk, high, high_pct, " + ", ".join(
    f"round({c} - lag({c}) OVER (ORDER BY run_version), 4) AS {c}_delta" if c in ("avg_risk", "high_pct")
    else f"{c} - lag({c}) OVER (ORDER BY run_version) AS {c}_delta"
    for c in ["messages", "avg_risk", "high", "high_pct"]) + " FROM tl"))
def kpi_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = H.kpi_delta(timeline(spark, sf_dir))
    return delta.withColumns({c: F.round(c, 4) for c in ("avg_risk_delta", "high_pct_delta")})


RULES = [("many high", "high_pct", 8.0), ("average up", "avg_risk", 0.2), ("high count", "high", 2.0)]


def _rules_sql() -> str:
    """Walks from each fired trigger to the next one after the cooldown that its day still allows."""
    fired = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, run_version, \"timestamp\", {metric}::DOUBLE AS value FROM tl WHERE {metric} >= {least}"
        for name, metric, least in RULES)
    return O.q("RECURSIVE " + _RUNS + f""",
    fired AS MATERIALIZED ({fired}),
    walk(rule, ts, n) AS (
      SELECT rule, min("timestamp"), 1 FROM fired GROUP BY rule
      UNION ALL
      SELECT rule, next, CASE WHEN next::DATE = ts::DATE THEN n + 1 ELSE 1 END FROM (
        SELECT w.*, (SELECT min(f."timestamp") FROM fired f
                     WHERE f.rule = w.rule AND f."timestamp" >= w.ts + INTERVAL 5 HOUR
                       AND (f."timestamp"::DATE <> w.ts::DATE OR w.n < 3)) AS next
        FROM walk w) WHERE next IS NOT NULL)""", """
    SELECT f.rule, f.run_version, round(f.value, 6) AS value
    FROM fired f JOIN walk w ON w.rule = f.rule AND w.ts = f."timestamp" """)


@query("alert_rules", _rules_sql())
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.alert_rules(timeline(spark, sf_dir), RULES, cooldown_hours=5, daily_cap=3).select(
        "rule", "run_version", *r6("value"))


@query("stream_alerts", _rules_sql())
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules over the timeline as a stream, a file of runs at a time."""
    out = scratch_dir(spark, "stream-alerts")
    rows = timeline(spark, sf_dir)
    rows.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("latestFirst", False).parquet(f"{out}/in")
    ST.write_stream(ST.alert_stream(stream, RULES, cooldown_hours=5, daily_cap=3), f"{out}/data", f"{out}/ck").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("rule", "run_version", *r6("value"))


def preset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the change log of presets, about a hundred names."""
    k = F.col("o_custkey")
    name = k % 101
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("change_id"),
        F.concat(F.lit(" preset <"), name, F.lit("> ")).alias("name"),
        ((k % 7) / 10).alias("min_risk"), F.lit(0.95).alias("max_risk"),
        F.when(k % 3 == 0, F.array(F.lit("Medium"), F.lit("High"))).alias("bands"),
        F.when(k % 5 == 0, F.array(F.lit("urgency_score"), F.lit("fear_score"))).alias("drivers"),
        F.when(k % 4 == 0, F.array(*[F.lit(f"src{i}") for i in range(10)])).alias("users"),
        F.when(k % 2 == 0, F.lit("ACC")).otherwise(F.lit("  ")).alias("text_query"),
        (F.lit(1) + k % 20).cast("int").alias("top_n"),
        F.col("o_orderdate").cast("timestamp").alias("changed_at"),
        (F.col("o_orderkey") % 4 == 3).alias("deleted"),
    )


_PRESETS = """changes AS MATERIALIZED (
  SELECT o_orderkey AS change_id, 'preset &lt;' || (o_custkey % 101) || '&gt;' AS name,
    (o_custkey % 7) / 10.0::DOUBLE AS min_risk, 0.95::DOUBLE AS max_risk,
    CASE WHEN o_custkey % 3 = 0 THEN ['Medium', 'High'] END AS bands,
    CASE WHEN o_custkey % 5 = 0 THEN ['urgency_score', 'fear_score'] END AS drivers,
    CASE WHEN o_custkey % 4 = 0 THEN [""" + ", ".join(f"'src{i}'" for i in range(10)) + """] END AS users,
    CASE WHEN o_custkey % 2 = 0 THEN 'ACC' ELSE '' END AS text_query,
    (1 + o_custkey % 20)::INTEGER AS top_n, o_orderdate::TIMESTAMP AS changed_at,
    o_orderkey % 4 = 3 AS deleted FROM orders),
presets AS MATERIALIZED (
  SELECT l.* FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY changed_at DESC, change_id DESC) AS rn FROM changes) l
  WHERE rn = 1 AND NOT deleted)"""


@query("preset_compaction", O.q(_PRESETS, """
    SELECT name, min_risk, max_risk, array_to_string(bands, ',') AS bands, top_n, change_id FROM presets"""))
def preset_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.live_presets(preset_changes(spark, sf_dir)).select(
        "name", "min_risk", "max_risk", F.array_join("bands", ",").alias("bands"), "top_n", "change_id")


@query("preset_store", O.q(_PRESETS, """
    SELECT name, min_risk, max_risk, array_to_string(bands, ',') AS bands, top_n, change_id FROM presets"""))
def preset_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same presets put, deleted, put a second time without effect, compacted and listed."""
    root = scratch_dir(spark, "presets")
    changes = preset_changes(spark, sf_dir)
    puts = changes.where(~F.col("deleted")).drop("deleted")
    PR.put(spark, root, puts.where("change_id % 2 = 0"))
    PR.delete(spark, root, changes.where("deleted").select("change_id", "name", "changed_at"))
    PR.put(spark, root, puts)
    PR.compact(spark, root)
    return PR.live(spark, root).select(
        "name", "min_risk", "max_risk", F.array_join("bands", ",").alias("bands"), "top_n", "change_id")


_MATCHED = O.RESULTS + ", " + _PRESETS + """,
matched AS MATERIALIZED (SELECT p.name, p.top_n, r.* FROM presets p JOIN res r
  ON r.risk_score BETWEEN p.min_risk AND p.max_risk
  AND (p.bands IS NULL OR list_contains(p.bands, r.risk_band))
  AND (p.drivers IS NULL OR list_contains(p.drivers, r.top_risk_driver))
  AND (p.users IS NULL OR list_contains(p.users, r."user"))
  AND contains(upper(r.text), upper(p.text_query)))"""


@query("preset_match", O.q(_MATCHED, """
    SELECT name, count(*) AS messages, round(avg(risk_score), 4) AS avg_risk,
      round(max(risk_score), 4) AS max_risk, count(*) FILTER (WHERE risk_band = 'High') AS high
    FROM matched GROUP BY name"""))
def preset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.preset_match(results(spark, sf_dir), H.live_presets(preset_changes(spark, sf_dir)))


@query("preset_top", O.q(_MATCHED, """
    SELECT name, msg_id, "user", rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (
      PARTITION BY name ORDER BY risk_score DESC, msg_id) AS rank FROM matched) WHERE rank <= top_n"""))
def preset_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = H.preset_top(results(spark, sf_dir), H.live_presets(preset_changes(spark, sf_dir)))
    return top.select("name", "msg_id", "user", "rank")


@query("precision_at_k", O.q(O.RESULTS + """,
  judged AS MATERIALIZED (SELECT r.*, d.lang, l.toxic = 1 AS bad, r.risk_band = 'High' AS flagged,
      row_number() OVER (PARTITION BY d.lang ORDER BY r.risk_score DESC, r.msg_id) AS rank
    FROM res r JOIN labels l ON l.doc_id = r.msg_id JOIN documents d ON d.doc_id = r.msg_id),
  c AS (SELECT lang, count(*) AS judged, count(*) FILTER (WHERE bad AND flagged) AS tp,
      count(*) FILTER (WHERE NOT bad AND flagged) AS fp, count(*) FILTER (WHERE bad AND NOT flagged) AS fn,
      count(*) FILTER (WHERE NOT bad AND NOT flagged) AS tn,
      count(*) FILTER (WHERE bad AND rank <= 20) AS hit, count(*) FILTER (WHERE rank <= 20) AS k
    FROM judged GROUP BY lang)""", """
    SELECT lang, judged, tp, fp, fn, tn, round(hit / nullif(k, 0)::DOUBLE, 6) AS precision_at_k,
      round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
      round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1,
      round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr FROM c"""))
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("msg_id"), (F.col("toxic") == 1).alias("bad"))
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), "lang")
    scored = results(spark, sf_dir).select("msg_id", "risk_score", "risk_band")
    quality = EV.quality(scored.join(langs, "msg_id"), labels, ["lang"], k=20)
    rates = ["precision_at_k", "precision", "recall", "f1", "fpr"]
    return quality.select("lang", "judged", "tp", "fp", "fn", "tn", *r6(*rates))


def _customer_weights(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Weights in proportion to the customers' balances, one per feature."""
    from tellsign.fixed import FEATURES

    share = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % len(FEATURES)).alias("i")).agg(
        F.round(F.sum(F.abs("c_acctbal")) / 1e6, 4).alias("w")).orderBy("i").collect()
    return {FEATURES[r["i"]]: r["w"] for r in share}


def _weights_sql(select: str) -> str:
    from tellsign.fixed import FEATURES, FEATURE_LABELS

    names = ", ".join(f"({i}, '{f}', '{FEATURE_LABELS[f]}')" for i, f in enumerate(FEATURES))
    return O.q(f"""w AS (SELECT n.ord, n.feature AS name, n.label AS feature, s.weight FROM (VALUES {names}) n(ord, feature, label)
      JOIN (SELECT c_custkey % {len(FEATURES)} AS i, round(sum(abs(c_acctbal))::DOUBLE / 1e6, 4) AS weight
            FROM customer GROUP BY 1) s ON s.i = n.ord)""", select)


@query("weight_table", _weights_sql(
    "SELECT feature, weight, round(weight / (SELECT sum(weight) FROM w) * 100, 1) AS pct, ord::INTEGER AS ord FROM w"))
def weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.weight_table(weight_frame(spark, _customer_weights(spark, sf_dir)))


@query("weight_report", _weights_sql(
    "SELECT ord::INTEGER AS ord, name AS feature, feature AS label, weight, true AS is_custom FROM w"))
def weight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellsign.sources.weights import weight_report as report

    return report(spark, _customer_weights(spark, sf_dir))


@query("weights_file", _weights_sql("SELECT ord::INTEGER AS ord, name AS feature, feature AS label, weight FROM w"))
def weights_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights written as a JSON file and read back in file order."""
    path = scratch_dir(spark, "weights")
    whole = json.dumps(_customer_weights(spark, sf_dir))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(path)
    return weight_frame(spark, read_weights(spark, path))
