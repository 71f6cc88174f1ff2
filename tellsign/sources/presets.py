"""Stored filter presets: an append-only change log, listed by its last live state, compacted as a job of its own."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.functions.triage import as_time
from tellsign.operators import history as H
from tellsign.sources import store

SCHEMA = ("change_id long, name string, min_risk double, max_risk double, bands array<string>, drivers array<string>, "
          "users array<string>, text_query string, top_n int, changed_at timestamp, deleted boolean")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _log(spark: SparkSession, root: str) -> str:
    """The log that counts: the one that was compacted last."""
    done = [v for v in store.numbers(spark, root, "log") if v == 0 or store.finished(spark, f"{root}/log={v}/kept")]
    return f"{root}/log={done[-1] if done else 0}"


def _changes(spark: SparkSession, root: str) -> DataFrame:
    log = _log(spark, root)
    parts = [spark.read.schema(SCHEMA).parquet(f"{log}/{p}") for p in ("kept", "changes") if store.exists(spark, f"{log}/{p}")]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else spark.createDataFrame([], SCHEMA)


def put(spark: SparkSession, root: str, presets: DataFrame) -> DataFrame:
    """Log presets (all columns but ``deleted``); the last write of a name wins.  Gives the refused rows with the reason.

    A change whose ``change_id`` is logged already is left out, so a repeated job adds nothing.
    """
    judged = presets.withColumn("deleted", F.lit(False)).select(*COLUMNS, H.preset_reject_reason().alias("reject_reason"))
    good = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    store.append_log(good, f"{_log(spark, root)}/changes", "change_id")
    return judged.where(F.col("reject_reason").isNotNull())


def delete(spark: SparkSession, root: str, names: DataFrame, now: dt.datetime | Column | None = None) -> None:
    """Log the deletion of presets: ``change_id, name`` and ``changed_at``, unless ``now`` gives that."""
    rows = names if now is None else names.withColumn("changed_at", as_time(now))
    typed = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
    whole = rows.select("change_id", "name", F.col("changed_at").cast("timestamp"), F.lit(True).alias("deleted"), *[
        F.lit(None).cast(kind).alias(c) for c, kind in typed.items() if c not in ("change_id", "name", "changed_at", "deleted")])
    store.append_log(whole.select(*COLUMNS), f"{_log(spark, root)}/changes", "change_id")


def live(spark: SparkSession, root: str) -> DataFrame:
    """The presets that are not deleted, each in its last state."""
    return H.live_presets(_changes(spark, root))


def compact(spark: SparkSession, root: str) -> None:
    """Start a new log with the last change of every name, deletions left out; one writer at a time."""
    following = max(store.numbers(spark, root, "log"), default=0) + 1
    last = H.last_changes(_changes(spark, root)).where(~F.col("deleted"))
    last.select(*COLUMNS).write.mode("errorifexists").parquet(f"{root}/log={following}/kept")
