"""Datasets of the dashboard charts, small enough to draw whatever the input's size."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellsign.fixed import BANDS, DEFAULT_WEIGHTS, FEATURES, THRESHOLD_LINES
from tellsign.functions import scoring as SC
from tellsign.operators.kpi import band_count, share
from tellsign.operators.quantiles import exact_quantiles
from tellsign.operators.rank import top_messages


def histogram(results: DataFrame, bins: int = 20) -> DataFrame:
    """Messages per score bin and band; a score of 1 falls into the last bin."""
    index = F.least(F.floor(F.col("risk_score") * bins), F.lit(bins - 1)).cast("int")
    return (
        results.groupBy(index.alias("bin"), "risk_band")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("bin_start", F.round(F.col("bin") / bins, 4))
    )


def density(results: DataFrame, bandwidth: float = 0.05, steps: int = 100) -> DataFrame:
    """Gaussian density of the score on an even grid over [0, 1].

    One sum for each grid point in a single pass, so a task leaves one row.
    """
    def at(x: float) -> Column:
        z = (F.lit(x) - F.col("risk_score")) / F.lit(bandwidth)
        return F.avg(F.exp(z * z * F.lit(-0.5)) / F.lit(bandwidth * math.sqrt(2 * math.pi)))

    sums = results.agg(*[at(i / steps).alias(f"at{i}") for i in range(steps + 1)])
    points = F.array(*[F.struct(F.lit(i / steps).alias("x"), F.col(f"at{i}").alias("density"))
                       for i in range(steps + 1)])
    return sums.select(F.inline(points)).filter(F.col("density").isNotNull())


def score_lines(results: DataFrame) -> DataFrame:
    """The median and the two band edges as lines of the histogram."""
    median = exact_quantiles(results, "risk_score", {"m": 0.5})
    lines = F.array(
        F.struct(F.lit("median").alias("line"), F.col("m").alias("at")),
        *[F.struct(F.lit(name).alias("line"), F.lit(at).alias("at")) for at, name in THRESHOLD_LINES],
    )
    return median.select(F.inline(lines))


def band_share(results: DataFrame) -> DataFrame:
    """Count and percentage of every band; empty bands stay."""
    counts = results.agg(*[band_count(name).alias(name) for name, _, _ in BANDS])
    total = sum((F.col(name) for name, _, _ in BANDS), F.lit(0))
    rows = F.array(*[
        F.struct(F.lit(name).alias("risk_band"), F.col(name).alias("count"),
                 share(F.col(name), total).alias("pct"))
        for name, _, _ in BANDS
    ])
    return counts.select(F.inline(rows)).withColumn(
        "label", F.format_string("%s  %.1f%%", "risk_band", "pct"))


def driver_share(results: DataFrame) -> DataFrame:
    counts = results.groupBy("top_risk_driver").agg(F.count(F.lit(1)).alias("count"))
    # One row per feature name reaches this window.
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(
        "top_risk_driver", SC.feature_label(F.col("top_risk_driver")).alias("label"), "count",
        share(F.col("count"), total).alias("pct"),
    ).orderBy(F.desc("count"), "top_risk_driver")


def contribution_heatmap(results: DataFrame, rows: int = 15, weights=DEFAULT_WEIGHTS) -> DataFrame:
    """Contributions of the riskiest messages, one row per message and feature."""
    cells = F.array(*[
        F.struct(F.lit(SC.label_of(f)).alias("feature"), F.col(f"contrib_{f}").alias("contribution"))
        for f in weights if f"contrib_{f}" in results.columns
    ])
    narrow = results.select("msg_id", "user", "risk_score", cells.alias("cells"))
    return top_messages(narrow, rows).select("msg_id", "user", F.inline("cells"))


def user_scatter(results: DataFrame) -> DataFrame:
    return results.groupBy("user").agg(
        F.avg("risk_score").alias("avg_risk"),
        F.count(F.lit(1)).alias("messages"),
        F.max("risk_score").alias("max_risk"),
    ).withColumn("labelled", F.col("avg_risk") >= 0.5)


def feature_correlation(results: DataFrame) -> DataFrame:
    """Pearson matrix of the features in long form; a constant feature gives nulls.

    Products of deviations from the means are summed, so nothing large cancels out, and one
    row leaves each task.  The means come from a first pass over the same narrow columns.
    """
    feats = [f for f in FEATURES if f in results.columns]
    means = results.agg(F.struct(*[F.avg(f).alias(f) for f in feats]).alias("m")).scalar()
    centred = results.select(*feats).withColumn("_m", means).select(
        *[(F.col(f) - F.col("_m")[f]).alias(f) for f in feats])
    n = len(feats)
    row = centred.agg(
        F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(feats) for b in feats[i:]]).alias("s"),
        F.array(*[F.max(f) > F.min(f) for f in feats]).alias("varies"),
    )

    def product(i: Column, j: Column) -> Column:
        """Sum for two features; only the upper triangle, row by row, is held."""
        a, b = F.least(i, j), F.greatest(i, j)
        return F.get("s", (a * n - F.floor(a * (a - 1) / 2) + b - a).cast("int"))

    cells = row.select("s", "varies", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("p"))
    cells = cells.select("s", "varies", F.floor(F.col("p") / n).cast("int").alias("i"),
                         (F.col("p") % n).alias("j"))
    i, j = F.col("i"), F.col("j")
    names = F.array(*[F.lit(SC.label_of(f)) for f in feats])
    r = F.when(i == j, F.lit(1.0)).otherwise(
        F.try_divide(product(i, j), F.sqrt(product(i, i) * product(j, j))))
    return cells.select(
        F.get(names, i).alias("feature_a"), F.get(names, j).alias("feature_b"),
        F.when(F.get("varies", i) & F.get("varies", j), r).alias("correlation"),
    ).withColumns({
        "abs_corr": F.abs("correlation"),
        "shown": F.coalesce(F.abs("correlation") >= 0.3, F.lit(False)),
    })


def user_boxplot(results: DataFrame, users: int = 12) -> DataFrame:
    """Five-number summary and mean of the users with the highest mean."""
    means = results.groupBy("user").agg(F.avg("risk_score").alias("mean"))
    top = means.orderBy(F.desc("mean"), "user").limit(users)
    rows = results.select("user", "risk_score").join(top.select("user"), "user", "left_semi")
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}
    box = exact_quantiles(rows, "risk_score", probs, ["user"])
    return top.join(box, "user").select(
        "user", F.col("q0").alias("min"), "q1", F.col("q2").alias("median"), "q3",
        F.col("q4").alias("max"), "mean",
    )


def weight_table(weights: DataFrame) -> DataFrame:
    """Weights with their percentage of the sum, largest first."""
    # A weight table has one row per feature.
    total = F.sum("weight").over(Window.partitionBy())
    return weights.select(
        F.col("label").alias("feature"), "weight",
        F.round(F.col("weight") / F.greatest(total, F.lit(1e-9)) * 100, 1).alias("pct"), "ord",
    ).orderBy(F.desc("weight"), "ord")


def feature_means(results: DataFrame) -> DataFrame:
    feats = [f for f in FEATURES if f in results.columns]
    row = results.agg(*[F.round(F.avg(f), 4).alias(f) for f in feats])
    cells = F.array(*[
        F.struct(F.lit(SC.label_of(f)).alias("feature"), F.col(f).alias("mean_score"))
        for f in feats
    ])
    return row.select(F.inline(cells)).orderBy(F.desc("mean_score"), "feature")
