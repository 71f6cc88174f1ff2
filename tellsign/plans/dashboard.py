"""All datasets of the dashboard for one filter."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellsign.fixed import BANDS, FEATURES
from tellsign.functions import scoring as SC
from tellsign.operators import charts as CH
from tellsign.operators import rank as R
from tellsign.operators.filters import ResultFilter
from tellsign.operators.kpi import share
from tellsign.operators.quantiles import exact_quantiles
from tellsign.session import written
from tellsign.sources.weights import weight_frame

#: Values of ``set`` in the facts: which columns a row is grouped by.
HISTOGRAM, DRIVER, USER, ALL = 3, 13, 14, 15
BINS = 20


def facts(filtered: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts, sums and extremes of the filtered rows by score bin and band, by driver, by user and over all.

    One scan and one shuffle of partial aggregates for all of them, as a written table of a row for each user, driver, bin and
    band; every one-row and grouped dataset is read from it.
    """
    index = F.least(F.floor(F.col("risk_score") * bins), F.lit(bins - 1)).cast("int")
    feats = [f for f in FEATURES if f in filtered.columns]
    keys = ["bin", "risk_band", "top_risk_driver", "user"]
    rows = filtered.select(index.alias("bin"), "risk_band", "top_risk_driver", "user", "risk_score", F.col("risk_band").alias("_band"), *feats)
    return written(rows.groupingSets([keys[:2], keys[2:3], keys[3:], []], *keys).agg(
        F.grouping_id().cast("int").alias("set"), F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("total"),
        F.max("risk_score").alias("most"), F.stddev_samp("risk_score").alias("std"),
        *[F.count_if(F.col("_band") == name).alias(name) for name, _, _ in BANDS],
        *[F.avg(f).alias(f"mean_{f}") for f in feats]), "facts")


class Board:
    """The datasets over the rows that a filter keeps; the stored results are read again only for single rows and ranks."""

    def __init__(self, results: DataFrame, spec: ResultFilter = ResultFilter()):
        self.results, self.spec, self.filtered = results, spec, spec.apply(results)
        self.facts = facts(self.filtered)

    def of(self, kind: int) -> DataFrame:
        return self.facts.where(F.col("set") == kind)

    def kpis(self) -> DataFrame:
        median = exact_quantiles(self.filtered, "risk_score", {"median_risk": 0.5})
        one = self.of(ALL).select(
            F.col("n").alias("messages"), F.round(F.col("total") / F.col("n"), 4).alias("avg_risk"), F.round("most", 4).alias("max_risk"),
            F.round(F.coalesce("std", F.lit(0.0)), 4).alias("std_risk"), F.col("High").alias("high"), F.col("Medium").alias("medium"),
            F.col("Low").alias("low"), share(F.col("High"), F.col("n")).alias("high_pct"))
        return one.withColumns({
            "users": self.of(USER).agg(F.count(F.lit(1))).scalar(), "median_risk": F.round(median.scalar(), 4),
            "total": self.results.agg(F.count(F.lit(1))).scalar()})

    def histogram(self) -> DataFrame:
        return self.of(HISTOGRAM).select("bin", "risk_band", F.col("n").alias("count"), F.round(F.col("bin") / BINS, 4).alias("bin_start"))

    def bands(self) -> DataFrame:
        """Every band, also without rows."""
        def whole(name: str) -> Column:
            return F.coalesce(F.sum(name), F.lit(0).cast("long"))

        row = self.of(ALL).agg(*[whole(name).alias(name) for name, _, _ in BANDS])
        total = sum((F.col(name) for name, _, _ in BANDS), F.lit(0))
        return row.select(F.inline(F.array(*[F.struct(
            F.lit(name).alias("risk_band"), F.col(name).alias("count"), share(F.col(name), total).alias("pct")) for name, _, _ in BANDS]))
        ).withColumn("label", F.format_string("%s  %.1f%%", "risk_band", "pct"))

    def drivers(self) -> DataFrame:
        total = self.of(ALL).agg(F.sum("n")).scalar()
        return self.of(DRIVER).select(
            "top_risk_driver", SC.feature_label(F.col("top_risk_driver")).alias("label"), F.col("n").alias("count"),
            share(F.col("n"), total).alias("pct")).orderBy(F.desc("count"), "top_risk_driver")

    def users(self) -> DataFrame:
        mean = F.col("total") / F.col("n")
        return self.of(USER).select(
            "user", mean.alias("mean"), F.round(mean, 4).alias("avg_risk"), F.round("most", 4).alias("max_risk"),
            F.col("n").alias("messages"), F.col("High").alias("high_count")).orderBy(F.desc("mean"), "user").drop("mean")

    def user_scatter(self) -> DataFrame:
        return self.of(USER).select("user", (F.col("total") / F.col("n")).alias("avg_risk"), F.col("n").alias("messages"),
                                    F.col("most").alias("max_risk")).withColumn("labelled", F.col("avg_risk") >= 0.5)

    def feature_means(self) -> DataFrame:
        feats = [f for f in FEATURES if f"mean_{f}" in self.facts.columns]
        return self.of(ALL).select(F.inline(F.array(*[F.struct(
            F.lit(SC.label_of(f)).alias("feature"), F.round(f"mean_{f}", 4).alias("mean_score")) for f in feats]))
        ).orderBy(F.desc("mean_score"), "feature")

    def dims(self) -> DataFrame:
        """Drivers of the filtered rows, users of all."""
        return self.of(DRIVER).select(F.lit("driver").alias("dim"), F.col("top_risk_driver").alias("value")).unionByName(
            self.results.select(F.lit("user").alias("dim"), F.col("user").alias("value")).distinct())

    def summary(self) -> DataFrame:
        driver = self.of(DRIVER).orderBy(F.desc("n"), "top_risk_driver").limit(1).select("top_risk_driver").scalar()
        mean = F.col("total") / F.col("n")
        user = self.of(USER).select("user", mean.alias("mean")).orderBy(F.desc("mean"), "user").limit(1)
        return self.of(ALL).withColumn("u", user.select(F.struct("user", "mean")).scalar()).select(
            F.col("High").alias("high_count"), share(F.col("High"), F.col("n")).alias("high_pct"),
            SC.feature_label(driver).alias("top_driver"), F.col("u.user").alias("top_user"), F.round("u.mean", 3).alias("top_user_risk"),
            F.round(mean, 4).alias("avg_risk"), F.col("n").alias("total_messages"))


def dashboard(
    results: DataFrame, spec: ResultFilter = ResultFilter(), weights: Mapping[str, float] | None = None
) -> dict[str, DataFrame]:
    """Frames by name, all over the same filtered rows of a stored result table."""
    board = Board(results, spec)
    return {
        "kpis": board.kpis(),
        "histogram": board.histogram(),
        "density": CH.density(board.filtered),
        "score_lines": CH.score_lines(board.filtered),
        "bands": board.bands(),
        "drivers": board.drivers(),
        "heatmap": CH.contribution_heatmap(board.filtered),
        "user_scatter": board.user_scatter(),
        "correlation": CH.feature_correlation(board.filtered),
        "boxplot": CH.user_boxplot(board.filtered),
        "weights": CH.weight_table(weight_frame(results.sparkSession, weights)),
        "feature_means": board.feature_means(),
        "users": board.users(),
        "messages": R.message_page(results, spec),
        "page": R.page_meta(results, spec),
        "detail_cards": R.top_cards(board.filtered),
        "dims": board.dims(),
        "summary": board.summary(),
        "total": results.agg(F.count(F.lit(1)).alias("total")),
    }
