"""KPI blocks, user tables and the summary of a result set."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellsign.fixed import FEATURES
from tellsign.functions import scoring as SC
from tellsign.operators.quantiles import exact_quantiles


def band_count(name: str) -> Column:
    return F.count_if(F.col("risk_band") == name)


def share(part: Column, whole: Column) -> Column:
    """Percentage with one digit; 0 of nothing is 0."""
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 1)


def _basics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("messages"),
        F.count_distinct("user").alias("users"),
        F.round(F.avg("risk_score"), 4).alias("avg_risk"),
        F.round(F.max("risk_score"), 4).alias("max_risk"),
        band_count("High").alias("high"),
        band_count("Medium").alias("medium"),
        band_count("Low").alias("low"),
        share(band_count("High"), F.count(F.lit(1))).alias("high_pct"),
    ]


def kpi_block(filtered: DataFrame, total: DataFrame) -> DataFrame:
    """The KPI row of a filtered result; ``total`` is the unfiltered one."""
    std = F.coalesce(F.stddev_samp("risk_score"), F.lit(0.0))
    median = exact_quantiles(filtered, "risk_score", {"median_risk": 0.5})
    return filtered.agg(*_basics(), F.round(std, 4).alias("std_risk")).withColumns({
        "median_risk": F.round(median.scalar(), 4),
        "total": total.agg(F.count(F.lit(1))).scalar(),
    }).filter(F.col("messages") > 0)


def kpi_snapshot(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KPI row per run; runs without messages give none.

    ``keys`` names the run (say ``run_version``), so one job can take many snapshots.
    """
    basics = results.groupBy(*keys).agg(*_basics())
    median = exact_quantiles(results, "risk_score", {"median_risk": 0.5}, keys)
    median = median.withColumn("median_risk", F.round("median_risk", 4))
    return basics.join(median, list(keys))


def user_ranking(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("user")
        .agg(
            F.avg("risk_score").alias("_avg"),
            F.round(F.avg("risk_score"), 4).alias("avg_risk"),
            F.round(F.max("risk_score"), 4).alias("max_risk"),
            F.count(F.lit(1)).alias("messages"),
            band_count("High").alias("high_count"),
        )
        .orderBy(F.desc("_avg"), "user")
        .drop("_avg")
    )


def user_summary(results: DataFrame) -> DataFrame:
    """Unrounded per-user table for export."""
    return (
        results.groupBy("user")
        .agg(
            F.avg("risk_score").alias("avg_risk"),
            F.max("risk_score").alias("max_risk"),
            F.count(F.lit(1)).alias("messages"),
        )
        .orderBy(F.desc("avg_risk"), "user")
    )


def user_profiles(results: DataFrame) -> DataFrame:
    """Profile of every user at once, with the mean of each feature as a map."""
    feats = [f for f in FEATURES if f in results.columns]
    per_user = results.groupBy("user").agg(
        F.count(F.lit(1)).alias("messages"),
        F.round(F.avg("risk_score"), 4).alias("avg_risk"),
        F.round(F.max("risk_score"), 4).alias("max_risk"),
        band_count("High").alias("high_count"),
        band_count("Medium").alias("med_count"),
        band_count("Low").alias("low_count"),
        *[F.round(F.avg(f), 4).alias(f"_m_{f}") for f in feats],
    )
    profile = F.map_from_arrays(
        F.array(*[F.lit(SC.label_of(f)) for f in feats]),
        F.array(*[F.col(f"_m_{f}") for f in feats]),
    )
    return per_user.withColumn("feature_profile", profile).drop(*[f"_m_{f}" for f in feats])


def executive_summary(filtered: DataFrame) -> DataFrame:
    """Most frequent driver, riskiest user and headline KPIs in one row.

    Counts and sums per (user, driver) are taken once; the three views are sums of those.
    """
    cube = filtered.groupBy("user", "top_risk_driver").agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("s"),
        band_count("High").alias("h"),
    )
    driver = (
        cube.groupBy("top_risk_driver").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "top_risk_driver").limit(1)
    )
    user = (
        cube.groupBy("user").agg((F.sum("s") / F.sum("n")).alias("mean"))
        .orderBy(F.desc("mean"), "user").limit(1)
    )
    best_user = user.select(F.struct("user", "mean").alias("u")).scalar()
    base = cube.agg(
        F.coalesce(F.sum("h"), F.lit(0)).alias("high_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_messages"),
        F.sum("s").alias("_s"),
    ).filter(F.col("total_messages") > 0)
    return base.withColumn("_u", best_user).select(
        "high_count",
        share(F.col("high_count"), F.col("total_messages")).alias("high_pct"),
        SC.feature_label(driver.select("top_risk_driver").scalar()).alias("top_driver"),
        F.col("_u.user").alias("top_user"),
        F.round("_u.mean", 3).alias("top_user_risk"),
        F.round(F.col("_s") / F.col("total_messages"), 4).alias("avg_risk"),
        "total_messages",
    )
