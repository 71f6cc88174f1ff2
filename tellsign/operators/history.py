"""Run history, append-only logs, filter presets and alert rules."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.functions.text import html_escape, strip
from tellsign.operators.kpi import band_count
from tellsign.operators.rank import by_risk


def tail_of_log(log: DataFrame, key: str, n: int) -> DataFrame:
    """The newest ``n`` entries in time order."""
    return log.orderBy(F.desc(key)).limit(n).orderBy(key)


def kpi_delta(timeline: DataFrame, key: str = "run_version") -> DataFrame:
    """Change of the headline KPIs against the run before.

    The timeline holds one row per run and is kept short, so one window may span it.
    """
    before = Window.partitionBy().orderBy(key)
    numbers = ["messages", "avg_risk", "high", "high_pct"]
    return timeline.select(key, *numbers, *[
        (F.col(c) - F.lag(c).over(before)).alias(f"{c}_delta") for c in numbers])


# --- Filter presets ------------------------------------------------------------------------
# Change log rows: change_id, name, min_risk, max_risk, bands, drivers, users, text_query,
# top_n, changed_at, deleted.


def preset_reject_reason() -> Column:
    """Name of the first field that makes a preset change invalid, else null."""
    def outside(name: str) -> Column:
        return F.col(name).isNull() | ~F.col(name).between(0.0, 1.0)

    return (
        F.when((strip(F.col("name")) == "") | (F.length("name") > 64), F.lit("name"))
        .when(outside("min_risk"), F.lit("min_risk")).when(outside("max_risk"), F.lit("max_risk"))
        .when(F.length("text_query") > 512, F.lit("text_query"))
        .when(F.col("top_n").isNull() | ~F.col("top_n").between(1, 1000), F.lit("top_n"))
    )


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of every name, as logged; invalid changes do not count."""
    valid = changes.filter(F.col("deleted") | preset_reject_reason().isNull())
    newest = Window.partitionBy(strip(F.col("name"))).orderBy(F.desc("changed_at"), F.desc("change_id"))
    return valid.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1).drop("_rn")


def live_presets(changes: DataFrame) -> DataFrame:
    """The last live state of every preset name.

    The last write of a name wins; invalid changes do not count.
    """
    return last_changes(changes).filter(~F.col("deleted")).drop("deleted").withColumn(
        "name", html_escape(strip(F.col("name"))))


#: Cells of the score that presets and messages meet in.
CELLS = 200


def _cell(score: Column) -> Column:
    return F.least(F.floor(score * CELLS), F.lit(CELLS - 1)).cast("int")


def _tagged(results: DataFrame, presets: DataFrame) -> DataFrame:
    """The results once for every preset that they match, with its ``name`` and ``top_n``.

    Presets are a table of any size: one row for each band and cell of the score that they want.  Messages meet them by
    band and cell, so where presets are not broadcast a task holds a cell and not a band (a crowded cell is split as
    any skewed join), and the other conditions are tested on what meets.  The text is folded once per message.
    """
    bands = F.when(F.size("bands") > 0, F.array_distinct("bands")).otherwise(
        F.array(*[F.lit(name) for name, _, _ in fixed.BANDS]))
    edges = F.create_map(*[x for name, low, high in fixed.BANDS for x in (
        F.lit(name), F.struct(F.lit(low).alias("low"), F.lit(min(high, 1.0)).alias("high")))])
    wanted = presets.select(
        "name", "top_n", F.explode(bands).alias("_band"), F.col("min_risk").alias("_lo"), F.col("max_risk").alias("_hi"),
        F.col("drivers").alias("_drivers"), F.col("users").alias("_users"),
        F.when(strip(F.col("text_query")) != "", F.upper("text_query")).alias("_query"))
    band = F.try_element_at(edges, F.col("_band"))
    first = _cell(F.greatest("_lo", band["low"]))
    last = _cell(F.least("_hi", band["high"]))
    wanted = wanted.where(last >= first).withColumn("_cell", F.explode(F.sequence(first, last)))

    def listed(names: str, value: str) -> Column:
        return (F.coalesce(F.size(names), F.lit(0)) <= 0) | F.array_contains(names, F.col(value))

    matches = (
        (F.col("risk_band") == F.col("_band")) & (_cell(F.col("risk_score")) == F.col("_cell"))
        & F.col("risk_score").between(F.col("_lo"), F.col("_hi"))
        & listed("_drivers", "top_risk_driver") & listed("_users", "user")
        & (F.col("_query").isNull() | F.contains("_upper", "_query")))
    return results.withColumn("_upper", F.upper("text")).join(wanted, matches).drop(
        "_upper", "_band", "_cell", "_lo", "_hi", "_drivers", "_users", "_query")


def preset_match(results: DataFrame, presets: DataFrame) -> DataFrame:
    """KPIs of all presets in one pass; a message is counted for each preset that it matches."""
    return _tagged(results, presets).groupBy("name").agg(
        F.count(F.lit(1)).alias("messages"),
        F.round(F.avg("risk_score"), 4).alias("avg_risk"),
        F.round(F.max("risk_score"), 4).alias("max_risk"),
        band_count("High").alias("high"),
    )


def preset_top(results: DataFrame, presets: DataFrame) -> DataFrame:
    """The top messages of every preset, each with its own ``top_n`` (at most 1,000)."""
    tagged = _tagged(results.select(
        "msg_id", "user", "text", "risk_score", "risk_band", "top_risk_driver"), presets)
    order = Window.partitionBy("name").orderBy(*by_risk())
    ranked = tagged.drop("text").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 1000)
    return ranked.filter(F.col("rank") <= F.col("top_n")).drop("top_n")


# --- Alert rules ---------------------------------------------------------------------------

RULE_METRICS = ["high_pct", "avg_risk", "high"]


def triggers(timeline: DataFrame, rules: Sequence[tuple[str, str, float]], key: str = "run_version") -> DataFrame:
    """``rule, run_version, timestamp, value`` of every run that reaches the smallest value of a rule; row-local."""
    bad = [r for r in rules if r[1] not in RULE_METRICS]
    if bad:
        raise ValueError(f"unknown metric in rules: {bad}")
    hits = F.array_compact(F.array(*[
        F.when(F.col(metric) >= least, F.struct(
            F.lit(name).alias("rule"), F.col(metric).cast("double").alias("value")))
        for name, metric, least in rules]))
    return timeline.select(F.col(key).cast("long").alias("run_version"), "timestamp", F.inline(hits)).select(
        "rule", "run_version", "timestamp", "value")


def alert_rules(
    timeline: DataFrame, rules: Sequence[tuple[str, str, float]],
    cooldown_hours: int = 24, daily_cap: int = 3, key: str = "run_version",
) -> DataFrame:
    """Runs that trigger a rule (name, metric, smallest value), thinned out per rule.

    A trigger within the cooldown after the one that fired before is suppressed; of the others
    at most ``daily_cap`` fire on a day.  Suppressed triggers use up nothing.  The triggers of a
    rule are folded in time order with the last fire and the count of its day.
    """
    fired = triggers(timeline, rules, key).withColumnRenamed("run_version", key)
    in_order = F.sort_array(F.collect_list(F.struct("timestamp", F.col(key).cast("bigint").alias("run"), "value")))
    none = F.array().cast("array<struct<timestamp:timestamp,run:bigint,value:double>>")
    start = F.struct(F.lit(None).cast("timestamp").alias("last"), F.lit(0).alias("n"), none.alias("fired"))
    wait = F.make_dt_interval(hours=F.lit(cooldown_hours))

    def step(acc: Column, x: Column) -> Column:
        at, last = x["timestamp"], acc["last"]
        today = F.when(F.to_date(at) == F.to_date(last), acc["n"]).otherwise(0)
        fires = (last.isNull() | (at >= last + wait)) & (today < daily_cap)
        fired = F.array(F.struct(at.alias("timestamp"), x["run"].alias("run"), x["value"].alias("value")))
        return F.when(fires, F.struct(
            at.alias("last"), (today + 1).alias("n"), F.concat(acc["fired"], fired).alias("fired"))).otherwise(acc)

    kept = fired.groupBy("rule").agg(in_order.alias("all")).select(
        "rule", F.explode(F.aggregate("all", start, step)["fired"]).alias("t"))
    return kept.select("rule", F.col("t.run").alias(key), F.col("t.timestamp").alias("timestamp"),
                       F.col("t.value").alias("value"))
