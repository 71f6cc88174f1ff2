"""Streaming jobs over message streams; the columns are those of the batch job."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tellsign.functions import signals as SG
from tellsign.operators import clean as C
from tellsign.operators.history import triggers
from tellsign.operators.kpi import share
from tellsign.operators.quantiles import exact_quantiles
from tellsign.plans.scoring import row_signals, score_features
from tellsign.sources import embeddings as E


def score_stream(
    messages: DataFrame,
    bounds: tuple[int, int],
    embeddings: DataFrame | None = None,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Score a stream of messages row by row.

    The length signal depends on the batch, so a stream takes the bounds of a stored run.
    ``embeddings`` is a static table, joined by key.
    """
    df = C.valid_messages(messages)
    if embeddings is not None:
        df = E.attach(df, embeddings)
    df = row_signals(df.withColumn("text_length", F.length("text")))
    shortest, longest = (F.lit(b) for b in bounds)
    signal = SG.length_signal(F.col("text_length"), shortest, longest)
    return score_features(df.withColumn("text_length_signal", signal), weights)


def dedup_stream(messages: DataFrame, delay: str) -> DataFrame:
    """Drop repeated (user, text) that arrive within the delay; keeps state no longer."""
    keyed = messages.withColumn("digest", F.sha2("text", 256)).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["user", "digest"]).drop("digest")


def window_counts(scored: DataFrame, width: str = "1 day", delay: str | None = "1 day") -> DataFrame:
    """Messages of each user and score in each closed time window; no ``delay`` if the stream has a watermark already.

    The state of a window is as large as its different (user, score), in as many tasks as there are
    shuffle partitions.
    """
    df = scored.withWatermark("ts", delay) if delay else scored
    return df.groupBy(F.window("ts", width), "user", "risk_score", "risk_band").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "user", "risk_score", "risk_band", "n")


def closed_kpis(counts: DataFrame) -> DataFrame:
    """Exact KPIs of closed windows from their ``window_counts``."""
    many = F.sum("n")

    def band(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("risk_band") == name, F.col("n"))), F.lit(0).cast("long"))

    users = counts.select("start", "user").distinct().groupBy("start").agg(F.count(F.lit(1)).alias("users"))
    basics = counts.groupBy("start").agg(
        many.alias("messages"), F.round(F.sum(F.col("risk_score") * F.col("n")) / many, 4).alias("avg_risk"),
        F.round(F.max("risk_score"), 4).alias("max_risk"), band("High").alias("high"), band("Medium").alias("medium"),
        band("Low").alias("low"), share(band("High"), many).alias("high_pct"))
    median = exact_quantiles(counts, "risk_score", {"median_risk": 0.5}, ["start"], weight="n")
    return basics.join(users, "start").join(median, "start").select(
        "start", "messages", "users", "avg_risk", "max_risk", F.round("median_risk", 4).alias("median_risk"),
        "high", "medium", "low", "high_pct")


def kpi_stream(
    scored: DataFrame, path: str, checkpoint: str, width: str = "1 day", delay: str | None = "1 day"
) -> StreamingQuery:
    """Append exact KPIs of each window, once it is closed, below ``path``.

    A window leaves the state as a whole, so its users and median are worked out by the batch operators
    from the rows of the one micro-batch that closes it.  Each micro-batch has a folder of its own: one that
    is delivered again replaces it.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        closed = f"{path}/closed/batch={batch_id}"
        batch.write.mode("overwrite").parquet(closed)
        closed_kpis(batch.sparkSession.read.schema(batch.schema).parquet(closed)).write.mode("overwrite").parquet(
            f"{path}/kpis/batch={batch_id}")

    return (
        window_counts(scored, width, delay).writeStream.foreachBatch(put).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    """The KPI rows of all closed windows."""
    return spark.read.parquet(f"{path}/kpis").drop("batch")


_FIRED = "rule string, run_version long, timestamp timestamp, value double"


def alert_stream(
    timeline: DataFrame, rules: Sequence[tuple[str, str, float]], cooldown_hours: int = 24, daily_cap: int = 3,
    key: str = "run_version",
) -> DataFrame:
    """Runs that trigger a rule, thinned out by cooldown and daily cap as ``alert_rules`` does, over a stream of KPI rows.

    The state of a rule is its last fire and the number on that day.  Rows of a micro-batch are taken in the order
    of time; a row older than the last fire is within the cooldown and never fires.
    """
    hits = triggers(timeline, rules, key)
    wait = cooldown_hours * 3_600_000_000

    def fold(rule: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["timestamp", "run_version", "value"])
        last, count = state.get if state.exists else (None, 0)
        fired = []
        for row in rows.itertuples(index=False):
            at = int(pd.Timestamp(row.timestamp).value // 1000)
            today = count if last is not None and at // 86_400_000_000 == last // 86_400_000_000 else 0
            if (last is None or at >= last + wait) and today < daily_cap:
                last, count = at, today + 1
                fired.append((rule[0], row.run_version, row.timestamp, row.value))
        if last is not None:
            state.update((last, count))
        yield pd.DataFrame(fired, columns=["rule", "run_version", "timestamp", "value"])

    return hits.groupBy("rule").applyInPandasWithState(
        fold, _FIRED, "last long, n int", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("run_version", key)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
