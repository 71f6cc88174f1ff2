"""The triage queue as set operations on a keyed table."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.functions import triage as TF
from tellsign.functions.scoring import feature_label
from tellsign.functions.text import html_escape, strip
from tellsign.operators.rank import by_risk
from tellsign.session import written

NOTES = "array<struct<time:timestamp,text:string>>"
ACTIVITY = "array<struct<time:timestamp,action:string,details:string>>"
SCHEMA = (
    "id string, user string, text string, risk_score double, risk_band string, "
    f"top_driver string, status string, assignee string, notes {NOTES}, activity {ACTIVITY}, "
    "present_in_latest_run boolean, created_at timestamp, updated_at timestamp"
)
COLUMNS = [
    "id", "user", "text", "risk_score", "risk_band", "top_driver", "status", "assignee",
    "notes", "activity", "present_in_latest_run", "created_at", "updated_at",
]
#: Commands that one task puts in order.
SEGMENT_ROWS = 100_000
BASE = ["user", "text", "risk_score", "risk_band", "top_driver"]


def empty_queue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def candidates(
    results: DataFrame, min_risk: float = fixed.TRIAGE_MIN_RISK, top_n: int | None = fixed.TRIAGE_MAX_ITEMS
) -> DataFrame:
    """The riskiest messages at or above a score, as queue rows; all of them if ``top_n`` is None."""
    best = results.filter(F.col("risk_score") >= min_risk)
    if top_n is not None:
        best = best.orderBy(*by_risk()).limit(max(1, top_n))
    return best.select(
        TF.message_id(F.col("user"), F.col("text")).alias("id"), "user", "text",
        F.round("risk_score", 4).alias("risk_score"), "risk_band",
        feature_label(F.col("top_risk_driver")).alias("top_driver"),
    ).dropDuplicates(["id"])


def merge(state: DataFrame, fresh: DataFrame, now: dt.datetime | Column,
          mark_stale: bool = True, first: Column | None = None) -> DataFrame:
    """Merge candidates into the queue by id.

    Known items get the fresh base fields and a new ``updated_at`` and keep the rest, new
    ones are inserted with their first activity, the others are flagged as not in this run
    (unless ``mark_stale`` is off, as in streams, where a batch is only part of a run).  ``first``
    is when an item was seen first, if that is not ``now``.
    """
    at = TF.as_time(now)
    first = at if first is None else first
    created = F.array(F.struct(
        first.alias("time"), F.lit("created").alias("action"),
        F.lit(fixed.TRIAGE_CREATED_DETAILS).alias("details"))).cast(ACTIVITY)
    s, c = state.alias("s"), fresh.withColumn("_in", F.lit(True)).alias("c")
    both = s.join(c, F.col("s.id") == F.col("c.id"), "full_outer")
    present = F.coalesce(F.col("c._in"), F.lit(False))
    old, is_new = F.col("s.id").isNotNull(), F.col("s.id").isNull()
    flag = present if mark_stale else F.coalesce(F.col("c._in"), F.col("s.present_in_latest_run"))
    kept = {
        "status": F.lit("new"), "assignee": F.lit(""), "notes": F.array().cast(NOTES),
        "activity": created, "created_at": first,
    }
    columns = {
        "id": F.coalesce("c.id", "s.id"),
        **{b: F.when(present, F.col(f"c.{b}")).otherwise(F.col(f"s.{b}")) for b in BASE},
        **{k: F.when(old, F.col(f"s.{k}")).otherwise(v) for k, v in kept.items()},
        "present_in_latest_run": flag,
        "updated_at": F.when(present | is_new, at).otherwise(F.col("s.updated_at")),
    }
    return both.select(*[columns[name].alias(name) for name in COLUMNS])


def sync(
    state: DataFrame, results: DataFrame, now: dt.datetime | Column,
    min_risk: float = fixed.TRIAGE_MIN_RISK, top_n: int | None = fixed.TRIAGE_MAX_ITEMS,
) -> DataFrame:
    """Queue after a run.  A run without any message changes nothing, flags included."""
    if not (0.0 <= min_risk <= 1.0 and (top_n is None or top_n >= 1)):
        raise ValueError("min_risk must be within [0, 1] and top_n at least 1")
    if results.isEmpty():
        return state
    return merge(state, candidates(results, min_risk, top_n), now)


# --- Update commands -----------------------------------------------------------------------
# Command tables: cmd_id, item_id, cmd_ts, status, assignee, note; null means "leave as is".


def explode_bulk(commands: DataFrame) -> DataFrame:
    """Commands for many ids (``item_ids``) as single commands in the order of the list."""
    return commands.select(
        "*", F.posexplode("item_ids").alias("pos", "item_id")
    ).drop("item_ids")


def bulk_reject_reason() -> Column:
    n = F.size("item_ids")
    too_many = F.when((n < 1) | (n > fixed.MAX_BULK_IDS), F.lit("item_ids"))
    return F.coalesce(too_many, reject_reason())


def reject_reason() -> Column:
    """Name of the first field that makes a command invalid, else null."""
    status = strip(F.col("status"))
    return (
        F.when(F.col("status").isNotNull() & ~status.isin(*fixed.TRIAGE_STATUSES), F.lit("status"))
        .when(F.length("assignee") > 128, F.lit("assignee"))
        .when(F.length("note") > 2000, F.lit("note"))
    )


def split_commands(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid commands, and rejected ones with the reason."""
    reason = bulk_reject_reason() if "item_ids" in commands.columns else reject_reason()
    judged = commands.withColumn("reject_reason", reason)
    return (judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            judged.filter(F.col("reject_reason").isNotNull()))


def not_found(state: DataFrame, commands: DataFrame) -> DataFrame:
    ids = state.select(F.col("id").alias("item_id"))
    return commands.join(ids, "item_id", "left_anti").select("item_id").distinct()


def bulk_counts(state: DataFrame, commands: DataFrame) -> DataFrame:
    """``cmd_id, asked, updated, not_found`` of each bulk command.

    An item counts as updated where the command changed something, against what the commands before it left.
    """
    flat = written(_normalised(explode_bulk(commands)), "bulk-commands")
    made, _ = changes(state, flat, normalised=True)
    updated = made.select("cmd_id", "item_id", "pos").distinct().groupBy("cmd_id").agg(
        F.count(F.lit(1)).alias("updated"))
    known = state.select(F.col("id").alias("item_id"), F.lit(1).alias("known"))
    asked = flat.select("cmd_id", "item_id").join(known, "item_id", "left").groupBy("cmd_id").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col("known").isNull()).alias("not_found"))
    return asked.join(updated, "cmd_id", "left").select(
        "cmd_id", "asked", F.coalesce("updated", F.lit(0)).alias("updated"), "not_found")


def _order() -> Column:
    return F.struct("cmd_ts", "cmd_id", "pos")


def _normalised(commands: DataFrame) -> DataFrame:
    if "pos" not in commands.columns:
        commands = commands.withColumn("pos", F.lit(0))
    note = html_escape(strip(F.col("note")))
    return commands.select(
        "cmd_id", "item_id", "cmd_ts", F.col("pos").cast("int").alias("pos"),
        F.when(F.col("status").isNotNull(), strip(F.col("status"))).alias("status"),
        F.when(F.col("assignee").isNotNull(), html_escape(strip(F.col("assignee")))).alias("assignee"),
        F.when(note != "", note).alias("note"),
    )


ORDER = ["cmd_ts", "cmd_id", "pos"]


def _segmented(rows: DataFrame, segment_rows: int) -> DataFrame:
    """``rows`` with ``segment``, cut by item and order into ranges of about ``segment_rows``, as a written table.

    Sampled bounds cut wherever the rows are dense, so the commands of one item, even of one time, are as many ranges as
    they need.  The table is written because a second run could draw other bounds; the rows are written before, because
    they are counted, sampled and cut.
    """
    rows = written(rows, "commands")
    parts = max(1, -(-rows.count() // segment_rows))
    return written(rows.repartitionByRange(parts, "item_id", *ORDER).withColumn("segment", F.spark_partition_id()), "segments")


def changes(
    state: DataFrame, commands: DataFrame, segment_rows: int = SEGMENT_ROWS, normalised: bool = False
) -> tuple[DataFrame, DataFrame]:
    """What each valid command really changed, and the last values per item and segment.

    A status or assignee counts as changed against the value before it.  The last value that is not null is
    associative, so an item's commands are cut into segments (``_segmented``), each is summed up to its last
    values, and the carry over the earlier segments is joined back.  A command takes the value before it
    from its own segment, else the carry, else the queue.  No item is gathered as a whole.
    ``normalised`` commands have gone through ``_normalised`` already.
    """
    known = state.select(
        F.col("id").alias("item_id"), F.col("status").alias("q_status"),
        F.coalesce("assignee", F.lit("")).alias("q_assignee"))
    rows = commands if normalised else _normalised(commands)
    rows = _segmented(rows.join(known, "item_id"), segment_rows)

    def last_of(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), _order()))

    summed = rows.groupBy("item_id", "segment").agg(
        last_of("status").alias("s_status"), last_of("assignee").alias("s_assignee"))
    earlier = Window.partitionBy("item_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = summed.select(
        "item_id", "segment",
        F.last("s_status", True).over(earlier).alias("c_status"),
        F.last("s_assignee", True).over(earlier).alias("c_assignee"))
    same_segment = Window.partitionBy("item_id", "segment").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(carried, ["item_id", "segment"]).withColumns({
        f"old_{n}": F.coalesce(F.last(n, True).over(same_segment), F.col(f"c_{n}"), F.col(f"q_{n}"))
        for n in ("status", "assignee")
    })

    def entry(k: int, action: str, when: Column, details: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(k).alias("k"), F.lit(action).alias("action"), details.alias("details")))

    def moved(name: str) -> Column:
        return F.concat(F.coalesce(f"old_{name}", F.lit("None")), F.lit(" -> "), F.col(name))

    differs = {n: F.col(n).isNotNull() & ~F.col(n).eqNullSafe(F.col(f"old_{n}"))
               for n in ("status", "assignee")}
    made = F.array_compact(F.array(
        entry(0, "status", differs["status"], moved("status")),
        entry(1, "assignee", differs["assignee"], moved("assignee")),
        entry(2, "note", F.col("note").isNotNull(), F.substring("note", 1, fixed.NOTE_EXCERPT)),
    ))
    made_rows = rows.select(
        "item_id", "cmd_ts", "cmd_id", "pos", "note", F.inline(made)
    )
    return made_rows, summed


def _latest(rows: DataFrame, n: int, entry: Column, name: str) -> DataFrame:
    """The last ``n`` entries per item in time order; the rank limit applies map-side."""
    newest = Window.partitionBy("item_id").orderBy(
        F.desc("cmd_ts"), F.desc("cmd_id"), F.desc("pos"), F.desc("k"))
    ordered = F.sort_array(F.collect_list(F.struct("cmd_ts", "cmd_id", "pos", "k", entry.alias("e"))))
    return (
        rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
        .groupBy("item_id")
        .agg(ordered.alias("_e"), F.max("cmd_ts").alias(f"{name}_at"))
        .select("item_id", F.transform("_e", lambda x: x["e"]).alias(name), f"{name}_at")
    )


def apply_commands(
    state: DataFrame, commands: DataFrame, changed: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Queue after valid commands, applied per item in the order of time and id.

    ``changed`` is what ``changes`` gave for them, if it is stored already.
    """
    made, summed = changes(state, commands) if changed is None else changed
    activity = _latest(
        made, fixed.MAX_ACTIVITY,
        F.struct(F.col("cmd_ts").alias("time"), "action", "details"), "new_activity")
    notes = _latest(
        made.filter(F.col("action") == "note"), fixed.MAX_NOTES,
        F.struct(F.col("cmd_ts").alias("time"), F.col("note").alias("text")), "new_notes")
    final = summed.groupBy("item_id").agg(*[
        F.max_by(f"s_{n}", F.when(F.col(f"s_{n}").isNotNull(), F.col("segment"))).alias(f"f_{n}") for n in ("status", "assignee")])
    updates = final.join(activity, "item_id", "left").join(notes.drop("new_notes_at"), "item_id", "left")
    joined = state.join(updates, F.col("id") == F.col("item_id"), "left")

    def appended(old: str, new: str, size: int) -> Column:
        whole = TF.tail(F.concat(F.coalesce(F.col(old), F.array().cast(
            NOTES if old == "notes" else ACTIVITY)), F.col(new)), size)
        return F.when(F.col(new).isNotNull(), whole).otherwise(F.col(old))

    return joined.withColumns({
        "status": F.coalesce("f_status", "status"),
        "assignee": F.coalesce("f_assignee", "assignee"),
        "notes": appended("notes", "new_notes", fixed.MAX_NOTES),
        "activity": appended("activity", "new_activity", fixed.MAX_ACTIVITY),
        "updated_at": F.coalesce("new_activity_at", "updated_at"),
    }).select(*COLUMNS)


def audit_entries(made: DataFrame) -> DataFrame:
    """Change rows as audit log entries; the id follows the command order."""
    return made.select(
        ((F.col("cmd_id") * 1000 + F.col("pos")) * 3 + F.col("k")).alias("id"),
        F.concat(F.lit("triage_"), F.col("action")).alias("action"),
        F.concat_ws(": ", "item_id", "details").alias("details"),
        F.col("cmd_ts").alias("created_at"),
    )


def upsert_items(state: DataFrame, items: DataFrame) -> DataFrame:
    """Replace or add whole items by id."""
    kept = state.join(items.select("id"), "id", "left_anti")
    return kept.select(*COLUMNS).unionByName(items.select(*COLUMNS))


def delete_items(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select(F.col("id")), "id", "left_anti").select(*COLUMNS)


# --- Reading the queue ---------------------------------------------------------------------


def with_deadline(state: DataFrame, now: dt.datetime | Column) -> DataFrame:
    due = TF.sla_due_at(F.col("risk_score"), F.col("status"), F.col("updated_at"),
                        F.col("created_at"), now)
    return state.withColumns({"priority": TF.priority(F.col("risk_score")), "sla_due_at": due}
                             ).withColumn("sla_breached",
                                          F.coalesce(TF.as_time(now) > F.col("sla_due_at"), F.lit(False)))


@dataclass(frozen=True)
class QueueFilter:
    statuses: Sequence[str] | None = None
    priorities: Sequence[str] | None = None
    assignee: str = ""
    text_query: str = ""
    min_risk: float = 0.0
    only_latest: bool = True
    top_n: int = 100

    def __post_init__(self) -> None:
        known = [p for p, _, _ in fixed.TRIAGE_PRIORITIES]
        bad = [s for s in self.statuses or [] if s not in fixed.TRIAGE_STATUSES]
        bad += [p for p in self.priorities or [] if p not in known]
        if bad:
            raise ValueError(f"unknown status or priority: {bad}")
        if len(self.assignee) > 128 or len(self.text_query) > 512:
            raise ValueError("assignee or text_query is too long")
        if not (0.0 <= self.min_risk <= 1.0 and 1 <= self.top_n <= 1000):
            raise ValueError("min_risk must be within [0, 1] and top_n within 1..1000")

    def predicate(self) -> Column:
        cond = F.col("risk_score") >= self.min_risk
        if self.only_latest:
            cond = cond & F.coalesce("present_in_latest_run", F.lit(False))
        if self.statuses:
            cond = cond & F.col("status").isin(*self.statuses)
        if self.priorities:
            cond = cond & F.col("priority").isin(*self.priorities)
        wanted = self.assignee.strip().lower()
        if wanted:
            cond = cond & F.contains(F.lower("assignee"), F.lit(wanted))
        text = self.text_query.strip().lower()
        if text:
            hit = [F.contains(F.lower(c), F.lit(text)) for c in ("text", "user", "top_driver")]
            cond = cond & (hit[0] | hit[1] | hit[2])
        return cond


def list_items(state: DataFrame, now: dt.datetime | Column, spec: QueueFilter = QueueFilter()) -> DataFrame:
    """Overdue first, then by status, priority and score; cut to ``top_n``."""
    rows = with_deadline(state, now).filter(spec.predicate())
    return rows.orderBy(
        F.when(F.col("sla_breached"), 0).otherwise(1),
        TF.status_rank(F.col("status")), TF.priority_rank(F.col("priority")),
        F.desc("risk_score"), "id",
    ).limit(spec.top_n)


def queue_summary(state: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Counts over all items; statuses and priorities without items count 0."""
    rows = with_deadline(state, now)
    is_open = F.col("status").isin(*fixed.TRIAGE_OPEN)
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_open).alias("open"),
        F.count_if(is_open & F.col("sla_breached")).alias("overdue_open"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in fixed.TRIAGE_STATUSES],
        *[F.count_if(F.col("priority") == p).alias(f"priority_{p}") for p, _, _ in fixed.TRIAGE_PRIORITIES],
    )


def system_status(state: DataFrame, results_version: int, triage_version: int) -> DataFrame:
    is_open = F.col("status").isin(*fixed.TRIAGE_OPEN)
    return state.agg(
        F.count(F.lit(1)).alias("triage_items"), F.count_if(is_open).alias("triage_open"),
    ).withColumns({
        "results_version": F.lit(results_version).cast("long"),
        "triage_version": F.lit(triage_version).cast("long"),
    })


def alert_payloads(items: DataFrame, event: str, now: dt.datetime | Column, status: DataFrame) -> DataFrame:
    """One JSON alert per item: event, time, system status and the item."""
    if not 1 <= len(event) <= 128:
        raise ValueError("event must have 1 to 128 characters")
    system = status.select(F.struct("*").alias("s")).scalar()
    return items.select("id", F.to_json(F.struct(
        F.lit(event).alias("event"),
        F.date_format(TF.as_time(now), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        system.alias("system"),
        F.struct("id", "user", "risk_score", "risk_band", "top_driver", "priority").alias("payload"),
    )).alias("payload"))
