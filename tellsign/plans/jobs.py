"""Jobs that write a table and hand back a reader of it."""
from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.functions.triage import as_time
from tellsign.operators import triage
from tellsign.operators.clean import require_rows, valid_messages
from tellsign.operators.kpi import kpi_snapshot
from tellsign.plans.scoring import build_features, feature_columns, score_features
from tellsign.session import scratch_dir, sized_shuffles
from tellsign.sources import store

_STAGED: dict[tuple, str] = {}


def score_and_store(
    raw: DataFrame,
    path: str,
    embeddings: DataFrame | None = None,
    weights: Mapping[str, float] | None = None,
    lexicon: Mapping[str, float] | DataFrame | None = None,
    phrases: DataFrame | None = None,
    unique: bool = False,
) -> DataFrame:
    """Score a batch and write it; the stored table is what all later questions read.

    Asking several questions of the unstored plan would repeat the text work for each, and
    a filter on the score, pushed below the projections, would even do it twice.
    """
    scored = score_features(build_features(raw, embeddings, lexicon, phrases=phrases, unique=unique), weights)
    with sized_shuffles(raw):
        scored.write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.parquet(path)


def stored_features(results: DataFrame) -> DataFrame:
    """The feature columns of a stored result table, the input of a rescoring."""
    return results.select(*feature_columns(results))


def _signature(spark: SparkSession, paths: list[str]) -> tuple:
    """Number, size and newest change of the input files (their content is not read)."""
    files = spark.read.format("binaryFile").load(paths)
    row = files.agg(
        F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string")).first()
    return tuple(row)


def staged(
    spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], DataFrame]
) -> DataFrame:
    """Run ``build(path)`` once per application and state of the inputs, then reread it."""
    key = (spark.sparkContext.applicationId, name, *inputs, _signature(spark, inputs))
    if key not in _STAGED:
        path = scratch_dir(spark, name)
        build(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def full_run(
    raw: DataFrame,
    root: str,
    run_version: int,
    now: dt.datetime | Column,
    embeddings: DataFrame | None = None,
    weights: Mapping[str, float] | None = None,
    lexicon: Mapping[str, float] | DataFrame | None = None,
    phrases: DataFrame | None = None,
) -> DataFrame:
    """One run: score and store, bring the triage queue up to date, append the KPIs (once for a version).

    A batch without a valid message is refused before anything is written.  Tables below ``root``: ``results/run=<n>``, ``queue`` (snapshots) and ``kpi_timeline``.
    """
    spark = raw.sparkSession
    started = time.monotonic()
    require_rows(valid_messages(raw))
    results = score_and_store(raw, f"{root}/results/run={run_version}", embeddings, weights, lexicon, phrases)
    state = store.read_snapshot(spark, f"{root}/queue")
    state = triage.empty_queue(spark) if state is None else state
    store.write_snapshot(triage.sync(state, results, now, top_n=None), f"{root}/queue")
    took = int((time.monotonic() - started) * 1000)
    run = results.withColumn("run_version", F.lit(run_version).cast("long"))
    snapshot = kpi_snapshot(run, ["run_version"]).withColumns({
        "timestamp": as_time(now), "duration_ms": F.lit(took).cast("long")})
    store.append_log(snapshot, f"{root}/kpi_timeline", "run_version")
    return results


def _log_changes(spark: SparkSession, root: str) -> None:
    """Append the audit entries of every snapshot that is written, then drop the kept changes.

    Entries go in by id, so a job that died after a part of this loses and doubles none of them.  Changes whose snapshot
    was never finished did not happen.
    """
    done = store.snapshot_versions(spark, f"{root}/queue")
    for version in store.numbers(spark, f"{root}/queue_changes", "version"):
        path = f"{root}/queue_changes/version={version}"
        if version in done:
            store.append_log(triage.audit_entries(spark.read.parquet(path)), f"{root}/audit_log", "id")
        store.remove(spark, path)


def update_queue(spark: SparkSession, root: str, commands: DataFrame) -> dict[str, DataFrame]:
    """Apply commands to the stored queue and write the next snapshot.

    Gives the new queue, the refused commands, the ids that were not found and the audit
    entries, which are also appended to ``audit_log``.  The changes are worked out once and kept under the version of the
    snapshot they lead to until they are logged; what a job that died left there is logged first.
    """
    _log_changes(spark, root)
    state = store.read_snapshot(spark, f"{root}/queue")
    if state is None:
        raise ValueError(f"no queue below {root}; run the scoring first")
    good, refused = triage.split_commands(commands)
    flat = triage.explode_bulk(good) if "item_ids" in good.columns else good
    made, summed = triage.changes(state, flat)
    version = store.next_version(spark, f"{root}/queue")
    kept = f"{root}/queue_changes/version={version}"
    made.write.mode("overwrite").parquet(kept)
    audit = triage.audit_entries(made)
    store.write_snapshot(
        triage.apply_commands(state, flat, (spark.read.schema(made.schema).parquet(kept), summed)), f"{root}/queue", version)
    _log_changes(spark, root)
    return {
        "queue": store.read_snapshot(spark, f"{root}/queue"), "refused": refused,
        "not_found": triage.not_found(state, flat), "audit": audit,
    }
