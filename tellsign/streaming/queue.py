"""A triage queue fed by streams: a base, one delta for each micro-batch, merged when it is read.

Below the root of a queue:

* ``base/version=<n>/items``: the whole queue as of some batches, ``base/version=<n>/through`` the last batch of each
  stream that is in it.  ``through`` is written last; a base without it was not finished and does not count.
* ``delta/stream=<key>/batch=<id>``: what one micro-batch found, one row an item.

A batch writes its delta and reads nothing, so its cost does not depend on the queue.  A batch that is delivered again
replaces its own delta, or is ignored if the base has it already.  ``read_queue`` folds the deltas after the base,
the newest of each item, and merges them into it; ``compact`` writes that as the next base.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tellsign import fixed
from tellsign.operators import triage as T
from tellsign.sources import store

DELTA = "id string, user string, text string, risk_score double, risk_band string, top_driver string, at timestamp"
THROUGH = "stream string, batch long"


def stream_key(checkpoint: str) -> str:
    """Names a stream by its checkpoint, which numbers its batches."""
    return hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def write_delta(scored: DataFrame, root: str, stream: str, batch: int, min_risk: float = fixed.TRIAGE_MIN_RISK) -> None:
    """Write what a batch found: one row for each risky item, dated by the newest ``ts`` among them."""
    hot = scored.where(F.col("risk_score") >= min_risk).groupBy(
        T.TF.message_id(F.col("user"), F.col("text")).alias("id")).agg(
        F.max_by(F.struct("user", "text", F.round("risk_score", 4).alias("risk_score"), "risk_band",
                          T.feature_label(F.col("top_risk_driver")).alias("top_driver")), "msg_id").alias("m"),
        F.max("ts").alias("at"))
    hot.select("id", "m.*", F.col("at").cast("timestamp")).write.mode("overwrite").parquet(
        f"{root}/delta/stream={stream}/batch={batch}")


def _bases(spark: SparkSession, root: str) -> list[int]:
    return [v for v in store.numbers(spark, f"{root}/base", "version") if store.finished(spark, f"{root}/base/version={v}/through")]


def _through(spark: SparkSession, root: str, version: int | None) -> dict[str, int]:
    if version is None:
        return {}
    rows = spark.read.schema(THROUGH).parquet(f"{root}/base/version={version}/through").collect()
    return {r["stream"]: r["batch"] for r in rows}


def _deltas(spark: SparkSession, root: str, through: dict[str, int]) -> dict[str, list[int]]:
    """Finished batches of each stream after those of the base, in order; from file names alone."""
    out = {}
    for stream in store.names(spark, f"{root}/delta", "stream"):
        folder = f"{root}/delta/stream={stream}"
        out[stream] = [b for b in store.numbers(spark, folder, "batch")
                       if b > through.get(stream, -1) and store.finished(spark, f"{folder}/batch={b}")]
    return out


def _folded(spark: SparkSession, root: str, batches: dict[str, list[int]]) -> DataFrame:
    """One row for each item of the deltas: its newest fields, when it was first and last seen.

    The date of a batch is the newest of its rows, as if the whole queue had been written then.
    """
    paths = [f"{root}/delta/stream={s}/batch={b}" for s, own in batches.items() for b in own]
    if not paths:
        return spark.createDataFrame([], DELTA + ", first_at timestamp, last_at timestamp").drop("at")
    rows = spark.read.option("basePath", f"{root}/delta").schema(DELTA + ", " + THROUGH).parquet(*paths)
    dates = rows.groupBy("stream", "batch").agg(F.max("at").alias("date"))
    order = F.struct("date", "stream", "batch")
    return rows.join(dates, ["stream", "batch"]).groupBy("id").agg(
        F.max_by(F.struct(*T.BASE), order).alias("m"), F.min("date").alias("first_at"), F.max("date").alias("last_at")
    ).select("id", "m.*", "first_at", "last_at")


def _state(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, int], int | None]:
    versions = _bases(spark, root)
    version = versions[-1] if versions else None
    through = _through(spark, root, version)
    batches = _deltas(spark, root, through)
    base = T.empty_queue(spark) if version is None else spark.read.schema(T.SCHEMA).parquet(f"{root}/base/version={version}/items")
    state = T.merge(base, _folded(spark, root, batches), F.col("c.last_at"), mark_stale=False, first=F.col("c.first_at"))
    return state, through | {s: own[-1] for s, own in batches.items() if own}, version


def read_queue(spark: SparkSession, root: str) -> DataFrame:
    """The queue as of the last finished batch."""
    return _state(spark, root)[0]


def write_base(spark: SparkSession, root: str, items: DataFrame, through: dict[str, int]) -> int:
    version = max(store.numbers(spark, f"{root}/base", "version"), default=0) + 1
    items.select(*T.COLUMNS).write.mode("errorifexists").parquet(f"{root}/base/version={version}/items")
    spark.createDataFrame(sorted(through.items()), THROUGH).coalesce(1).write.parquet(f"{root}/base/version={version}/through")
    return version


def compact(spark: SparkSession, root: str) -> int:
    """Write the merged queue as the next base; streams may go on meanwhile.  Gives its version."""
    state, through, version = _state(spark, root)
    if version is not None and through == _through(spark, root, version):
        return version
    return write_base(spark, root, state, through)


def update(spark: SparkSession, root: str, commands: DataFrame) -> int:
    """Apply valid update commands to the merged queue; the next base holds them."""
    state, through, _ = _state(spark, root)
    return write_base(spark, root, T.apply_commands(state, commands), through)


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all bases but the newest ``keep`` and the deltas that the oldest of these holds."""
    versions = _bases(spark, root)[-max(keep, 1):]
    if not versions:
        return
    for version in store.numbers(spark, f"{root}/base", "version"):
        if version < versions[0]:
            store.remove(spark, f"{root}/base/version={version}")
    for stream, last in _through(spark, root, versions[0]).items():
        for batch in store.numbers(spark, f"{root}/delta/stream={stream}", "batch"):
            if batch <= last:
                store.remove(spark, f"{root}/delta/stream={stream}/batch={batch}")


def triage_stream(scored: DataFrame, root: str, checkpoint: str, min_risk: float = fixed.TRIAGE_MIN_RISK) -> StreamingQuery:
    """Feed the queue below ``root`` from a scored stream, one delta a micro-batch."""
    key = stream_key(checkpoint)

    def put(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch, root, key, batch_id, min_risk)

    return scored.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
