"""Queries over the triage queue."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.operators import triage as T
from tellsign.plans import oracle_base as O
from tellsign.plans.catalog import features, query, results
from tellsign.plans.jobs import staged
from tellsign.plans.scoring import rescore
from tellsign.plans.queries_signals import r6, r6_sql
from tellsign.sources.tables import table

# Weights of the earlier run, so that the queue holds known, new and stale items.
FIRST_WEIGHTS = {"fear_score": 0.7, "semantic_signal": 0.3}
FIRST_RUN, SECOND_RUN, THIRD_RUN = (
    "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-20 06:00:00")
NOW = "2024-01-30 20:00:00"


def at(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def stamp_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


def first_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rescore(features(spark, sf_dir), FIRST_WEIGHTS)
    return T.sync(T.empty_queue(spark), scored, at(FIRST_RUN))


def second_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after two runs, stored as a run would store it."""
    inputs = [f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet"]
    return staged(spark, "queue", inputs, lambda path: T.sync(
        first_queue(spark, sf_dir), results(spark, sf_dir), at(SECOND_RUN)).write.parquet(path))


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an update command for the message with twelve times its user number."""
    events = table(spark, sf_dir, "events")
    ids = results(spark, sf_dir).select(
        (F.col("msg_id")).alias("m"), T.TF.message_id(F.col("user"), F.col("text")).alias("found"))
    e = F.col("event_id")
    return events.join(ids, F.col("m") == F.col("user_id") * 12, "left").select(
        e.alias("cmd_id"),
        F.coalesce("found", F.concat(F.lit("unknown-"), F.col("user_id"))).alias("item_id"),
        F.col("ts").cast("timestamp").alias("cmd_ts"),
        F.when(e % 5 == 0, F.lit("in_progress")).when(e % 5 == 1, F.lit(" mitigated "))
        .when(e % 5 == 2, F.lit("bogus")).when(e % 5 == 4, F.lit("false_positive")).alias("status"),
        F.when(e % 3 == 0, F.concat(F.lit("ana"), e % 4)).when(e % 3 == 1, F.lit("R&D")).alias("assignee"),
        F.when(e % 2 == 0, F.concat(F.lit(" <b>"), "event_type", F.lit("</b> "), e))
        .when(e % 7 == 0, F.lit("   ")).alias("note"),
    )


# --- SQL twins -----------------------------------------------------------------------------

def _cands(res: str) -> str:
    return f"""
    SELECT substr(sha1("user" || chr(10) || text), 1, 16) AS id, "user", text,
      round(risk_score, 4) AS risk_score, risk_band, {O.label('top_risk_driver')} AS top_driver
    FROM (SELECT * FROM {res} WHERE risk_score >= 0.7 ORDER BY risk_score DESC, msg_id LIMIT 250)"""


_FIRST = O.RESULTS + f""",
res0 AS MATERIALIZED ({O.scored('feats', FIRST_WEIGHTS)}),
c1 AS ({_cands('res0')}),
c2 AS MATERIALIZED ({_cands('res')}),
q1 AS (SELECT *, 'new' AS status, '' AS assignee, true AS present_in_latest_run,
  TIMESTAMP '{FIRST_RUN}' AS created_at, TIMESTAMP '{FIRST_RUN}' AS updated_at FROM c1)"""
SECOND = _FIRST + f""",
q2 AS MATERIALIZED (
  SELECT coalesce(c.id, q.id) AS id, coalesce(c."user", q."user") AS "user",
    coalesce(c.text, q.text) AS text, coalesce(c.risk_score, q.risk_score) AS risk_score,
    coalesce(c.risk_band, q.risk_band) AS risk_band, coalesce(c.top_driver, q.top_driver) AS top_driver,
    coalesce(q.status, 'new') AS status, coalesce(q.assignee, '') AS assignee,
    c.id IS NOT NULL AS present_in_latest_run,
    coalesce(q.created_at, TIMESTAMP '{SECOND_RUN}') AS created_at,
    CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{SECOND_RUN}' ELSE q.updated_at END AS updated_at
  FROM q1 q FULL OUTER JOIN c2 c ON q.id = c.id)"""
COMMANDS = SECOND + """,
cmds AS MATERIALIZED (
  SELECT e.event_id AS cmd_id, coalesce(substr(sha1(r."user" || chr(10) || r.text), 1, 16),
      'unknown-' || e.user_id) AS item_id, e.ts AS cmd_ts,
    CASE e.event_id % 5 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'mitigated' WHEN 2 THEN 'bogus'
      WHEN 4 THEN 'false_positive' END AS status,
    CASE e.event_id % 3 WHEN 0 THEN 'ana' || (e.event_id % 4) WHEN 1 THEN 'R&amp;D' END AS assignee,
    CASE WHEN e.event_id % 2 = 0 THEN '&lt;b&gt;' || e.event_type || '&lt;/b&gt; ' || e.event_id END AS note
  FROM events e LEFT JOIN res r ON r.msg_id = e.user_id * 12),
good AS MATERIALIZED (SELECT * FROM cmds WHERE status IS NULL OR status <> 'bogus'),
known AS (SELECT g.*, q.status AS q_status, q.assignee AS q_assignee
  FROM good g JOIN q2 q ON q.id = g.item_id),
olds AS (SELECT *,
    coalesce(last_value(status IGNORE NULLS) OVER w, q_status) AS old_status,
    coalesce(last_value(assignee IGNORE NULLS) OVER w, q_assignee) AS old_assignee
  FROM known WINDOW w AS (PARTITION BY item_id ORDER BY cmd_ts, cmd_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
made AS MATERIALIZED (
  SELECT item_id, cmd_ts, cmd_id, 0 AS k, 'status' AS action, old_status || ' -> ' || status AS details,
    NULL AS note FROM olds WHERE status <> old_status
  UNION ALL SELECT item_id, cmd_ts, cmd_id, 1, 'assignee', old_assignee || ' -> ' || assignee, NULL
    FROM olds WHERE assignee <> old_assignee
  UNION ALL SELECT item_id, cmd_ts, cmd_id, 2, 'note', substr(note, 1, 120), note
    FROM olds WHERE note IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cmd_ts DESC, cmd_id DESC, k DESC) AS rn,
    row_number() OVER (PARTITION BY item_id, action ORDER BY cmd_ts DESC, cmd_id DESC) AS rna FROM made),
act AS (SELECT item_id, string_agg(action || '|' || details, ';' ORDER BY cmd_ts, cmd_id, k) AS trail,
    count(*) AS n, max(cmd_ts) AS last_at FROM ranked WHERE rn <= 50 GROUP BY item_id),
nts AS (SELECT item_id, string_agg(note, ';' ORDER BY cmd_ts, cmd_id) AS notes, count(*) AS n
  FROM ranked WHERE action = 'note' AND rna <= 25 GROUP BY item_id),
fin AS (SELECT item_id, arg_max(status, (cmd_ts, cmd_id)) FILTER (WHERE status IS NOT NULL) AS status,
    arg_max(assignee, (cmd_ts, cmd_id)) FILTER (WHERE assignee IS NOT NULL) AS assignee
  FROM known GROUP BY item_id),
q3 AS MATERIALIZED (
  SELECT q.* EXCLUDE (status, assignee, updated_at), coalesce(f.status, q.status) AS status,
    coalesce(f.assignee, q.assignee) AS assignee, coalesce(a.last_at, q.updated_at) AS updated_at,
    CASE WHEN a.n IS NULL OR a.n < 50 THEN 'created|@DETAILS@' || coalesce(';' || a.trail, '') ELSE a.trail END AS trail,
    least(1 + coalesce(a.n, 0), 50)::INTEGER AS n_activity,
    coalesce(n.notes, '') AS notes, coalesce(n.n, 0)::INTEGER AS n_notes
  FROM q2 q LEFT JOIN fin f ON f.item_id = q.id LEFT JOIN act a ON a.item_id = q.id
  LEFT JOIN nts n ON n.item_id = q.id)""".replace("@DETAILS@", fixed.TRIAGE_CREATED_DETAILS)


def deadlines(src: str) -> str:
    prio = "CASE WHEN risk_score >= 0.9 THEN 'P1' WHEN risk_score >= 0.8 THEN 'P2' ELSE 'P3' END"
    return f"""
    SELECT *, coalesce(TIMESTAMP '{NOW}' > sla_due_at, false) AS sla_breached FROM (
      SELECT *, CASE WHEN status IN ('new', 'in_progress') THEN coalesce(updated_at, created_at)
        + CASE priority WHEN 'P1' THEN INTERVAL 4 HOUR WHEN 'P2' THEN INTERVAL 12 HOUR
          ELSE INTERVAL 24 HOUR END END AS sla_due_at
      FROM (SELECT *, {prio} AS priority FROM {src}))"""


_DUE = COMMANDS + f""",
due AS MATERIALIZED ({deadlines('q3')})"""


@query("triage_ids", O.q(O.RESULTS, """
    SELECT msg_id, substr(sha1("user" || chr(10) || text), 1, 16) AS id FROM res"""))
def triage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select(
        "msg_id", T.TF.message_id(F.col("user"), F.col("text")).alias("id"))


@query("triage_candidates", O.q(_FIRST, 'SELECT * FROM c2'))
def triage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.candidates(results(spark, sf_dir))


_QUEUE = ["id", "user", "risk_score", "risk_band", "top_driver", "status", "assignee",
          "present_in_latest_run"]
_QUEUE_SQL = ", ".join(f'"{c}"' for c in _QUEUE)


@query("triage_sync", O.q(SECOND, f"""
    SELECT {_QUEUE_SQL}, {stamp_sql('created_at')}, {stamp_sql('updated_at')},
      1::INTEGER AS n_activity FROM q2"""))
def triage_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = T.sync(first_queue(spark, sf_dir), results(spark, sf_dir), at(SECOND_RUN))
    return queue.select(*_QUEUE, stamp("created_at"), stamp("updated_at"),
                        F.size("activity").alias("n_activity"))


@query("triage_sync_rerun", O.q(SECOND, f"""
    SELECT {_QUEUE_SQL}, {stamp_sql('created_at')}, strftime(CASE WHEN present_in_latest_run
      THEN TIMESTAMP '{THIRD_RUN}' ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at,
      1::INTEGER AS n_activity FROM q2"""))
def triage_sync_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = T.sync(second_queue(spark, sf_dir), results(spark, sf_dir), at(THIRD_RUN))
    return queue.select(*_QUEUE, stamp("created_at"), stamp("updated_at"),
                        F.size("activity").alias("n_activity"))


def fresh_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = T.split_commands(event_commands(spark, sf_dir))
    return T.apply_commands(second_queue(spark, sf_dir), good)


def updated_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after the commands, stored like every version of it."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings", "events")]
    return staged(spark, "queue-updated", inputs,
                  lambda path: fresh_queue(spark, sf_dir).write.parquet(path))


@query("triage_commands", O.q(COMMANDS, f"""
    SELECT id, status, assignee, n_notes, notes, n_activity, trail, {stamp_sql('updated_at')} FROM q3"""))
def triage_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = F.transform("activity", lambda a: F.concat(a["action"], F.lit("|"), a["details"]))
    return fresh_queue(spark, sf_dir).select(
        "id", "status", "assignee", F.size("notes").alias("n_notes"),
        F.array_join(F.transform("notes", lambda n: n["text"]), ";").alias("notes"),
        F.size("activity").alias("n_activity"), F.array_join(trail, ";").alias("trail"),
        stamp("updated_at"))


@query("triage_rejected", O.q(COMMANDS, """
    SELECT cmd_id, 'status' AS reject_reason FROM cmds WHERE status = 'bogus'"""))
def triage_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split_commands(event_commands(spark, sf_dir))[1].select("cmd_id", "reject_reason")


def bulk_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bulk requests: each customer number stands for up to three messages."""
    ids = results(spark, sf_dir).select(
        "msg_id", T.TF.message_id(F.col("user"), F.col("text")).alias("found"))
    # One row for each order; rows that repeat it repeat its ids.
    orders = table(spark, sf_dir, "orders").groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).cast("int").alias("times"))
    asked = orders.select("o_custkey").distinct().select(
        "o_custkey", F.explode(F.array(*[F.col("o_custkey") + i for i in range(3)])).alias("m"))
    named = asked.join(ids, F.col("m") == F.col("msg_id"), "left").select(
        "o_custkey", "m", F.coalesce("found", F.concat(F.lit("unknown-"), F.col("m"))).alias("item_id"))
    # Three ids per customer: a bounded list.
    lists = named.groupBy(F.col("o_custkey").alias("customer")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("m", "item_id"))), lambda x: x["item_id"]).alias("ids"))
    return orders.join(lists, F.col("o_custkey").eqNullSafe(F.col("customer"))).withColumn(
        "item_ids", F.flatten(F.transform("ids", lambda x: F.array_repeat(x, F.col("times"))))
    ).select(
        F.col("o_orderkey").alias("cmd_id"), "item_ids", at(THIRD_RUN).alias("cmd_ts"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("mitigated")).alias("status"),
        F.lit("night shift").alias("assignee"), F.lit(None).cast("string").alias("note"))


_BULK = SECOND + """,
flat AS MATERIALIZED (
  SELECT o.o_orderkey AS cmd_id, o.o_custkey, coalesce(substr(sha1(r."user" || chr(10) || r.text), 1, 16),
      'unknown-' || (o.o_custkey + i)) AS item_id
  FROM orders o, (SELECT unnest([0, 1, 2]) AS i) LEFT JOIN res r ON r.msg_id = o.o_custkey + i)"""


@query("triage_bulk_not_found", O.q(_BULK, """
    SELECT DISTINCT item_id FROM flat WHERE item_id NOT IN (SELECT id FROM q2)"""))
def triage_bulk_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = T.split_commands(bulk_commands(spark, sf_dir))
    return T.not_found(second_queue(spark, sf_dir), T.explode_bulk(good))


@query("triage_bulk_counts", O.q(_BULK + """,
  each AS (SELECT f.cmd_id, q.id, f.o_custkey % 2 = 0 AS even, q.status, coalesce(q.assignee, '') AS assignee,
      coalesce(bool_or(f.o_custkey % 2 = 0) OVER earlier, false) AS even_before,
      count(*) OVER earlier > 0 AS before
    FROM flat f LEFT JOIN q2 q ON q.id = f.item_id
    WINDOW earlier AS (PARTITION BY f.item_id ORDER BY f.cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", """
    SELECT cmd_id, count(*) AS asked, count(*) FILTER (WHERE id IS NOT NULL AND (
        (even AND NOT even_before AND status <> 'mitigated') OR (NOT before AND assignee <> 'night shift'))) AS updated,
      count(*) FILTER (WHERE id IS NULL) AS not_found FROM each GROUP BY cmd_id"""))
def triage_bulk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = T.split_commands(bulk_commands(spark, sf_dir))
    return T.bulk_counts(second_queue(spark, sf_dir), good)


@query("triage_upsert", O.q(SECOND, """
    SELECT id, CASE WHEN risk_score >= 0.75 THEN 'lead' ELSE assignee END AS assignee, risk_score FROM q2"""))
def triage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items replaced by id."""
    queue = second_queue(spark, sf_dir)
    items = queue.filter(F.col("risk_score") >= 0.75).withColumn("assignee", F.lit("lead"))
    return T.upsert_items(queue, items).select("id", "assignee", "risk_score")


@query("triage_bulk_update", O.q(_BULK, """
    SELECT q.id, CASE WHEN bool_or(f.o_custkey % 2 = 0) THEN 'mitigated' ELSE any_value(q.status) END AS status,
      CASE WHEN count(f.cmd_id) > 0 THEN 'night shift' ELSE any_value(q.assignee) END AS assignee,
      (1 + (count(f.cmd_id) > 0)::INTEGER + coalesce(bool_or(f.o_custkey % 2 = 0), false)::INTEGER)::INTEGER AS n_activity
    FROM q2 q LEFT JOIN flat f ON f.item_id = q.id GROUP BY q.id"""))
def triage_bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = T.split_commands(bulk_commands(spark, sf_dir))
    queue = T.apply_commands(second_queue(spark, sf_dir), T.explode_bulk(good))
    return queue.select("id", "status", "assignee", F.size("activity").alias("n_activity"))


@query("triage_sla", O.q(_DUE, f"""
    SELECT id, status, priority, {stamp_sql('sla_due_at')}, sla_breached FROM due"""))
def triage_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_deadline(updated_queue(spark, sf_dir), at(NOW)).select(
        "id", "status", "priority", stamp("sla_due_at"), "sla_breached")


LIST = T.QueueFilter(statuses=["new", "in_progress", "false_positive"], priorities=["P1", "P2", "P3"],
                     text_query=" URG", min_risk=0.71, only_latest=False, top_n=40)


@query("triage_list", O.q(_DUE, f"""
    SELECT id, "user", status, assignee, priority, risk_score, sla_breached FROM due
    WHERE risk_score >= 0.71 AND status IN ('new', 'in_progress', 'false_positive')
      AND (contains(lower(text), 'urg') OR contains(lower("user"), 'urg') OR contains(lower(top_driver), 'urg'))
    ORDER BY CASE WHEN sla_breached THEN 0 ELSE 1 END,
      CASE status WHEN 'new' THEN 0 WHEN 'in_progress' THEN 1 WHEN 'mitigated' THEN 2 ELSE 3 END,
      priority, risk_score DESC, id LIMIT 40"""))
def triage_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.list_items(updated_queue(spark, sf_dir), at(NOW), LIST).select(
        "id", "user", "status", "assignee", "priority", "risk_score", "sla_breached")


@query("triage_summary", O.q(_DUE, """
    SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('new', 'in_progress')) AS open,
      count(*) FILTER (WHERE status IN ('new', 'in_progress') AND sla_breached) AS overdue_open, """ +
    ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS status_{s}" for s in fixed.TRIAGE_STATUSES) + ", " +
    ", ".join(f"count(*) FILTER (WHERE priority = '{p}') AS priority_{p}"
              for p, _, _ in fixed.TRIAGE_PRIORITIES) + " FROM due"))
def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.queue_summary(updated_queue(spark, sf_dir), at(NOW))


@query("system_status", O.q(COMMANDS, """
    SELECT count(*) AS triage_items, count(*) FILTER (WHERE status IN ('new', 'in_progress')) AS triage_open,
      2::BIGINT AS results_version, 3::BIGINT AS triage_version FROM q3"""))
def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.system_status(updated_queue(spark, sf_dir), 2, 3)


@query("bounded_tail", O.q(COMMANDS, """
    SELECT item_id, string_agg(note, ';' ORDER BY cmd_ts, cmd_id) AS tail FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cmd_ts DESC, cmd_id DESC) AS rn
      FROM made WHERE action = 'note') WHERE rn <= 25 GROUP BY item_id"""))
def bounded_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = updated_queue(spark, sf_dir).filter(F.size("notes") > 0)
    return queue.select(F.col("id").alias("item_id"), F.array_join(F.transform(
        T.TF.tail(F.col("notes"), fixed.MAX_NOTES), lambda n: n["text"]), ";").alias("tail"))


@query("audit_tail", O.q(COMMANDS, """
    SELECT cmd_id * 3000 + k AS id, 'triage_' || action AS action, item_id || ': ' || details AS details,
      strftime(cmd_ts, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM made ORDER BY 1 DESC LIMIT 500"""))
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellsign.operators.history import tail_of_log

    good, _ = T.split_commands(event_commands(spark, sf_dir))
    made, _ = T.changes(second_queue(spark, sf_dir), good)
    log = tail_of_log(T.audit_entries(made), "id", fixed.AUDIT_TAIL)
    return log.select("id", "action", "details", stamp("created_at"))


@query("alert_payload", O.q(_FIRST + f""",
  st AS (SELECT count(*) AS n FROM c2)""", f"""
    SELECT id, '{{"event":"high_risk_alert","generated_at":"' || '2024-01-30T20:00:00Z' ||
      '","system":{{"triage_items":' || st.n || ',"triage_open":' || st.n ||
      ',"results_version":1,"triage_version":1}},"payload":{{"id":"' || id || '","user":"' || "user" ||
      '","risk_score":' || risk_score || ',"risk_band":"' || risk_band || '","top_driver":"' || top_driver ||
      '","priority":"' || CASE WHEN risk_score >= 0.9 THEN 'P1' WHEN risk_score >= 0.8 THEN 'P2' ELSE 'P3' END ||
      '"}}}}' AS payload FROM c2, st"""))
def alert_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = T.sync(T.empty_queue(spark), results(spark, sf_dir), at(SECOND_RUN))
    items = T.with_deadline(queue, at(NOW))
    return T.alert_payloads(items, "high_risk_alert", at(NOW), T.system_status(queue, 1, 1))
