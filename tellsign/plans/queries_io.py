"""Queries that write and read back: files, exports, stored tables and streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.operators import clean as C
from tellsign.operators import triage as T
from tellsign.operators.filters import ResultFilter
from tellsign.plans import oracle_base as O
from tellsign.plans.catalog import query, results
from tellsign.plans.jobs import score_and_store
from tellsign.plans.queries_signals import r6, r6_sql
from tellsign.plans.queries_triage import NOW, at
from tellsign.plans.scoring import FEATURE_COLUMNS
from tellsign.session import scratch_dir
from tellsign.sources import exports as X
from tellsign.sources import files as FI
from tellsign.sources import store
from tellsign.sources.embeddings import stored_embeddings
from tellsign.sources.tables import plant, planted_messages, table
from tellsign.streaming import queue as SQ
from tellsign.streaming import score as ST


@query("score_batch", O.q(O.RESULTS, f"""
    SELECT msg_id, "user", risk_band, top_risk_driver, {r6_sql('risk_score')} FROM res"""))
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scoring job, written and read back."""
    stored = score_and_store(planted_messages(spark, sf_dir), scratch_dir(spark, "scored"),
                             stored_embeddings(spark, sf_dir))
    return stored.select("msg_id", "user", "risk_band", "top_risk_driver", *r6("risk_score"))


@query("csv_ingest", O.q(O.CLEAN, """
    SELECT "user", text, substr(sha1("user" || chr(10) || text), 1, 16) AS msg_id FROM clean"""))
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as a file, read, cleaned and keyed by content."""
    path = scratch_dir(spark, "messages")
    FI.write_messages(planted_messages(spark, sf_dir), path)
    return C.with_message_id(FI.read_messages(spark, path)).select("msg_id", "user", "text")


@query("encoding_fallback", O.q(O.PLANTED, """
    SELECT "user", text FROM planted WHERE text <> '' """))
def encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in one folder, in Latin-1 files where that has all letters of some sources, else in UTF-8."""
    path = scratch_dir(spark, "encodings")
    rows = planted_messages(spark, sf_dir).filter(F.col("text") != "")
    fits = F.coalesce((F.col("user") < "src5") & F.col("text").rlike(r"(?s)^[\x{0}-\x{FF}]*$"), F.lit(False))
    FI.write_messages(rows.filter(fits), f"{path}/latin1", "ISO-8859-1")
    FI.write_messages(rows.filter(~fits), f"{path}/utf8")
    return FI.read_messages(spark, f"{path}/*", null_tokens=False)


_EXPORTED = ["msg_id", "user", "text", "risk_score", "risk_band"]
_EXPORT_SCHEMA = "msg_id long, user string, text string, risk_score double, risk_band string"


_DOUBLES = [c for c in FEATURE_COLUMNS if c not in ("msg_id", "user", "text", "text_length")] + [
    f"contrib_{f}" for f in fixed.FEATURES] + ["risk_raw", "risk_score"]
_WHOLE_SCHEMA = "msg_id long, user string, text string, text_length int, " + ", ".join(
    f"{c} double" for c in _DOUBLES) + ", top_risk_driver string, risk_band string"
_META = "title string, generated string, records long, weights string"


@query("csv_export", O.q(O.RESULTS, f"""
    SELECT msg_id, "user", text, text_length, {r6_sql(*_DOUBLES)}, top_risk_driver, risk_band, 'Export' AS title,
      '2024-01-30T20:00:00Z' AS generated, count(*) OVER () AS records, 'default' AS weights FROM res"""))
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of all results, with the metadata beside them."""
    path = scratch_dir(spark, "export")
    names = [c.split()[0] for c in _WHOLE_SCHEMA.split(", ")]
    X.export_results(results(spark, sf_dir).select(*names), path, at(NOW), "default")
    meta = spark.read.schema(_META).json(f"{path}/meta").select(F.struct("*").alias("m")).scalar()
    back = X.read_export(spark, f"{path}/data", _WHOLE_SCHEMA).withColumn("m", meta)
    return back.select("msg_id", "user", "text", "text_length", *r6(*_DOUBLES), "top_risk_driver", "risk_band", "m.*")


@query("csv_export_users", O.q(O.RESULTS, """
    SELECT "user", round(avg(risk_score), 6) AS avg_risk, round(max(risk_score), 6) AS max_risk,
      count(*) AS messages FROM res GROUP BY "user" """))
def csv_export_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "users")
    X.export_users(results(spark, sf_dir), path)
    back = X.read_export(spark, path, "user string, avg_risk double, max_risk double, messages long")
    return back.select("user", *r6("avg_risk", "max_risk"), "messages")


@query("csv_export_filtered", O.q(O.RESULTS, """
    SELECT msg_id, "user", text, risk_band, 'Filtered Export' AS title, '2024-01-30T20:00:00Z' AS generated,
      count(*) OVER () AS records, (SELECT count(*) FROM res) AS total,
      0.4::DOUBLE AS min_risk, 1.0::DOUBLE AS max_risk
    FROM res WHERE risk_score BETWEEN 0.4 AND 1.0 AND risk_band = 'High'"""))
def csv_export_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "filtered")
    spec = ResultFilter(min_risk=0.4, bands=["High"])
    X.export_filtered(results(spark, sf_dir).select(*_EXPORTED), spec, path, at(NOW))
    meta = spark.read.schema(
        "title string, generated string, records long, total long, min_risk double, max_risk double"
    ).json(f"{path}/meta").select(F.struct("*").alias("m")).scalar()
    back = X.read_export(spark, f"{path}/data", _EXPORT_SCHEMA)
    return back.select("msg_id", "user", "text", "risk_band", meta.alias("m")).select(
        "msg_id", "user", "text", "risk_band", "m.*")


@query("triage_store", O.q(O.RESULTS, """
    SELECT substr(sha1("user" || chr(10) || text), 1, 16) AS id, round(risk_score, 4) AS risk_score
    FROM (SELECT * FROM res WHERE risk_score >= 0.7 ORDER BY risk_score DESC, msg_id LIMIT 250)
    WHERE "user" <> 'src0' """))
def triage_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue written, cut by a delete, written again and loaded."""
    root = scratch_dir(spark, "queue-store")
    store.write_snapshot(
        T.sync(T.empty_queue(spark), results(spark, sf_dir), at(NOW)), root)
    queue = store.read_snapshot(spark, root)
    store.write_snapshot(T.delete_items(queue, queue.filter(F.col("user") == "src0")), root)
    return store.read_snapshot(spark, root).select("id", "risk_score")


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    # A stream takes a folder or a pattern, no single file; the pattern stands for the table in either form.
    return plant(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]"))


def _bounds(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    row = results(spark, sf_dir).agg(F.min("text_length"), F.max("text_length")).first()
    return row[0], row[1]


def timed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed documents with the time of the event of the same number."""
    times = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"))
    return document_stream(spark, sf_dir).join(times, "msg_id")


def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.score_stream(timed_stream(spark, sf_dir), _bounds(spark, sf_dir), stored_embeddings(spark, sf_dir))


@query("stream_scores", O.q(O.RESULTS, f"""
    SELECT msg_id, risk_band, top_risk_driver, {r6_sql('risk_raw')} FROM res
    WHERE msg_id IN (SELECT event_id FROM events)"""))
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream scores of the messages that a batch keeps; the batch drops repeated ones."""
    out = scratch_dir(spark, "stream-scores")
    ST.write_stream(scored_stream(spark, sf_dir), f"{out}/data", f"{out}/ck").awaitTermination()
    kept = results(spark, sf_dir).select("msg_id")
    return spark.read.parquet(f"{out}/data").join(kept, "msg_id", "left_semi").select(
        "msg_id", "risk_band", "top_risk_driver", *r6("risk_raw"))


_STREAM_RESULTS = O.CLEAN + f""",
  timed AS MATERIALIZED (SELECT msg_id, {O.strip('"user"')} AS "user", {O.strip('text')} AS text,
    length({O.strip('text')})::INTEGER AS text_length, ts FROM planted JOIN events ON event_id = msg_id),
  arrived AS MATERIALIZED (SELECT * EXCLUDE (ts) FROM timed WHERE "user" <> '' AND text <> ''),
  ahits AS MATERIALIZED ({O.hits('arrived')}),
  asent AS MATERIALIZED ({O.sentiment('arrived')}),
  afeats AS MATERIALIZED ({O.features('clean', 'ahits', 'asent')}),
  ares AS MATERIALIZED ({O.scored('afeats')})"""


@query("stream_kpis", O.q(_STREAM_RESULTS, """
    SELECT start, count(*) AS messages, count(DISTINCT "user") AS users, round(avg(risk_score), 4) AS avg_risk,
      round(max(risk_score), 4) AS max_risk, round(median(risk_score), 4) AS median_risk,
      count(*) FILTER (risk_band = 'High') AS high, count(*) FILTER (risk_band = 'Medium') AS medium,
      count(*) FILTER (risk_band = 'Low') AS low, round(count(*) FILTER (risk_band = 'High') / count(*) * 100, 1) AS high_pct
    FROM (SELECT a.*, time_bucket(INTERVAL 6 HOUR, t.ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS start FROM ares a JOIN timed t USING (msg_id))
    WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts::TIMESTAMP) FROM timed JOIN arrived USING (msg_id)) - INTERVAL 2 HOUR
    GROUP BY start"""))
def stream_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact KPIs of the windows that the watermark has closed; the end of the stream stays open."""
    out = scratch_dir(spark, "stream-kpis")
    ST.kpi_stream(scored_stream(spark, sf_dir), out, f"{out}/ck", "6 hours", "2 hours").awaitTermination()
    return ST.read_kpis(spark, out)


@query("stream_dedup", O.q(O.PLANTED + f""",
  arrived AS (SELECT DISTINCT {O.strip('"user"')} AS "user", {O.strip('text')} AS text FROM planted JOIN events ON event_id = msg_id)""",
    """SELECT "user", sha256(text) AS digest, 1::BIGINT AS copies FROM arrived WHERE "user" <> '' AND text <> '' """))
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream without the messages that repeat a user's text within the delay."""
    out = scratch_dir(spark, "stream-dedup")
    once = ST.dedup_stream(C.valid_messages(timed_stream(spark, sf_dir)), "60 days")
    ST.write_stream(once.select("user", F.sha2("text", 256).alias("digest")), f"{out}/data", f"{out}/ck").awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("user", "digest").agg(F.count(F.lit(1)).alias("copies"))


@query("stream_triage", O.q(O.RESULTS + f""",
  allrows AS (SELECT DISTINCT {O.strip('"user"')} AS "user", {O.strip('text')} AS text FROM planted
              JOIN events ON event_id = msg_id)""", f"""
    SELECT substr(sha1(r."user" || chr(10) || r.text), 1, 16) AS id, round(r.risk_score, 4) AS risk_score,
      'new' AS status, true AS present_in_latest_run
    FROM res r JOIN allrows a ON a."user" = r."user" AND a.text = r.text WHERE r.risk_score >= 0.7"""))
def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue that a stream feeds, merged from its deltas."""
    out = scratch_dir(spark, "stream-triage")
    SQ.triage_stream(scored_stream(spark, sf_dir), f"{out}/queue", f"{out}/ck").awaitTermination()
    return SQ.read_queue(spark, f"{out}/queue").select("id", "risk_score", "status", "present_in_latest_run")


@query("stream_triage_compacted", O.q(_STREAM_RESULTS + f""",
  risky AS (SELECT substr(sha1("user" || chr(10) || text), 1, 16) AS id, max_by(round(risk_score, 4), msg_id) AS risk_score
    FROM ares WHERE risk_score >= 0.7 GROUP BY ALL),
  newest AS (SELECT max(ts::TIMESTAMP) AS seen FROM timed JOIN ares USING (msg_id) WHERE risk_score >= 0.7)""", f"""
    SELECT id, risk_score, CASE WHEN risk_score >= 0.8 THEN 'in_progress' ELSE 'new' END AS status,
      CASE WHEN risk_score >= 0.8 THEN TIMESTAMP '{NOW}' ELSE seen END AS updated_at, seen AS created_at,
      CASE WHEN risk_score >= 0.8 THEN 'created,status' ELSE 'created' END AS actions
    FROM risky, newest"""))
def stream_triage_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queue compacted, worked on by commands, compacted and expired again."""
    out = scratch_dir(spark, "stream-queue")
    root = f"{out}/queue"
    SQ.triage_stream(scored_stream(spark, sf_dir), root, f"{out}/ck").awaitTermination()
    SQ.compact(spark, root)
    commands = SQ.read_queue(spark, root).where("risk_score >= 0.8").select(
        F.xxhash64("id").alias("cmd_id"), F.col("id").alias("item_id"), at(NOW).alias("cmd_ts"), F.lit("in_progress").alias("status"),
        F.lit(None).cast("string").alias("assignee"), F.lit(None).cast("string").alias("note"))
    SQ.update(spark, root, commands)
    SQ.compact(spark, root)
    SQ.expire(spark, root, keep=1)
    return SQ.read_queue(spark, root).select("id", "risk_score", "status", "updated_at", "created_at",
                                             F.array_join(F.col("activity.action"), ",").alias("actions"))
