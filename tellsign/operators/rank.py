"""Sorted views: rankings, pages, cards and the console report."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellsign.fixed import DEFAULT_WEIGHTS, FEATURES
from tellsign.functions import scoring as SC
from tellsign.operators.filters import ResultFilter


def by_risk() -> list:
    return [F.desc("risk_score"), F.asc("msg_id")]


def sorted_results(results: DataFrame) -> DataFrame:
    """Full sort by score; the key breaks ties."""
    return results.orderBy(*by_risk())


def top_messages(results: DataFrame, n: int) -> DataFrame:
    """A limit over a sort becomes a per-task heap, never a full sort."""
    return results.orderBy(*by_risk()).limit(n)


def message_page(results: DataFrame, spec: ResultFilter) -> DataFrame:
    """One page of the capped ranking with rounded values."""
    page = top_messages(spec.apply(results), spec.top_n).orderBy(*by_risk())
    page = page.offset(spec.offset).limit(spec.limit)
    numbers = [c for c in ["risk_score", *FEATURES] if c in results.columns]
    return page.select(
        "msg_id", "user", "text", "risk_band", "top_risk_driver",
        *[F.round(c, 4).alias(c) for c in numbers],
    )


def page_meta(results: DataFrame, spec: ResultFilter) -> DataFrame:
    """Paging numbers; the total is the capped one."""
    capped = spec.apply(results).select("msg_id").limit(spec.top_n)
    left = F.greatest(F.col("total_filtered") - spec.offset, F.lit(0))
    return capped.agg(F.count(F.lit(1)).alias("total_filtered")).select(
        F.lit(spec.offset).cast("long").alias("offset"),
        F.lit(spec.limit).cast("long").alias("limit"),
        "total_filtered",
        F.least(left, F.lit(spec.limit)).cast("long").alias("returned"),
        (F.lit(spec.offset + spec.limit) < F.col("total_filtered")).alias("has_more"),
    )


def detail_cards(
    rows: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS, extra: Sequence[str] = ()
) -> DataFrame:
    """Card of each row: rounded score, band and colour, driver label, contributions."""
    names = [f for f in weights if f"contrib_{f}" in rows.columns]
    contributions = F.map_from_arrays(
        F.array(*[F.lit(SC.label_of(f)) for f in names]),
        F.array(*[F.round(f"contrib_{f}", 4) for f in names]),
    )
    return rows.select(
        "msg_id", "user", "text",
        F.round("risk_score", 4).alias("risk_score"),
        "risk_band",
        SC.band_color(F.col("risk_band")).alias("band_color"),
        SC.feature_label(F.col("top_risk_driver")).alias("top_driver"),
        contributions.alias("contributions"),
        *extra,
    )


def top_cards(results: DataFrame, n: int = 5) -> DataFrame:
    return detail_cards(top_messages(results, n))


def top_rows_per_user(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` riskiest messages of every user.

    Spark applies the rank limit before the shuffle too (``WindowGroupLimit``), so a user
    with a third of all rows sends ``n`` rows per task and not all of them.
    """
    order = Window.partitionBy("user").orderBy(*by_risk())
    return results.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def user_cards(results: DataFrame, n: int = 10) -> DataFrame:
    best = top_rows_per_user(results, n)
    return detail_cards(best, extra=["rank"])


def console_report(results: DataFrame, top: int = 20) -> DataFrame:
    """User, score with two digits and driver of the riskiest messages."""
    return top_messages(results, max(1, top)).select(
        "user",
        F.format_string("%.2f", "risk_score").alias("risk_score"),
        F.coalesce("top_risk_driver", F.lit("n/a")).alias("top_driver"),
    )


def distinct_dims(filtered: DataFrame, results: DataFrame) -> DataFrame:
    """Drivers of the filtered rows and users of all rows, for drop-down lists."""
    drivers = filtered.select(F.lit("driver").alias("dim"), F.col("top_risk_driver").alias("value"))
    users = results.select(F.lit("user").alias("dim"), F.col("user").alias("value"))
    both = drivers.unionAll(users).filter(F.col("value").isNotNull())
    return both.distinct().orderBy("dim", "value")
