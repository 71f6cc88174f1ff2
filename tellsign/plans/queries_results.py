"""Queries over scored results: filters, rankings, KPIs and chart datasets."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.functions.scoring import label_of
from tellsign.operators import charts as CH
from tellsign.operators import kpi as K
from tellsign.operators import rank as R
from tellsign.operators.filters import ResultFilter
from tellsign.plans import oracle_base as O
from tellsign.plans.catalog import query, results
from tellsign.plans.dashboard import Board
from tellsign.plans.queries_signals import r6, r6_sql

COMBO = ResultFilter(min_risk=0.2, max_risk=0.95, bands=["Medium", "High"],
                     drivers=["urgency_score", "authority_score", "sentiment_risk_signal"],
                     users=[f"src{i}" for i in range(0, 20, 3)], text_query="AppROVed")
COMBO_SQL = """risk_score BETWEEN 0.2 AND 0.95 AND risk_band IN ('Medium', 'High')
    AND top_risk_driver IN ('urgency_score', 'authority_score', 'sentiment_risk_signal')
    AND "user" IN (""" + ", ".join(f"'src{i}'" for i in range(0, 20, 3)) + """)
    AND contains(upper(text), upper('AppROVed'))"""
WIDE = ResultFilter(min_risk=0.1, top_n=60, offset=20, limit=30)


@query("filter_combo", O.q(O.RESULTS, f"""
    SELECT msg_id, "user", risk_band, top_risk_driver, {r6_sql('risk_score')}
    FROM res WHERE {COMBO_SQL}"""))
def filter_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return COMBO.apply(results(spark, sf_dir)).select(
        "msg_id", "user", "risk_band", "top_risk_driver", *r6("risk_score"))


@query("filter_text_literal", O.q(O.RESULTS, f"""
    SELECT msg_id, "user", {r6_sql('risk_score')} FROM res
    WHERE contains(upper(text), upper('. t')) AND risk_score BETWEEN 0.0 AND 1.0"""))
def filter_text_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ResultFilter(text_query=". t")
    return spec.apply(results(spark, sf_dir)).select("msg_id", "user", *r6("risk_score"))


_COUNTS = """count(*) FILTER (WHERE risk_band = 'High') AS high,
    count(*) FILTER (WHERE risk_band = 'Medium') AS medium,
    count(*) FILTER (WHERE risk_band = 'Low') AS low,
    round(count(*) FILTER (WHERE risk_band = 'High') / count(*)::DOUBLE * 100, 1) AS high_pct"""


@query("kpi_block", O.q(O.RESULTS, f"""
    SELECT count(*) AS messages, (SELECT count(*) FROM res) AS total,
      count(DISTINCT "user") AS users, round(avg(risk_score), 4) AS avg_risk,
      round(max(risk_score), 4) AS max_risk, round(median(risk_score), 4) AS median_risk,
      round(coalesce(stddev_samp(risk_score), 0), 4) AS std_risk, {_COUNTS}
    FROM res WHERE risk_score BETWEEN 0.1 AND 1.0"""))
def kpi_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_rows = results(spark, sf_dir)
    return K.kpi_block(ResultFilter(min_risk=0.1).apply(all_rows), all_rows)


@query("user_ranking", O.q(O.RESULTS, """
    SELECT "user", round(avg(risk_score), 4) AS avg_risk, round(max(risk_score), 4) AS max_risk,
      count(*) AS messages, count(*) FILTER (WHERE risk_band = 'High') AS high_count
    FROM res GROUP BY "user" """))
def user_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.user_ranking(results(spark, sf_dir))


@query("user_export", O.q(O.RESULTS, """
    SELECT "user", round(avg(risk_score), 6) AS avg_risk, round(max(risk_score), 6) AS max_risk,
      count(*) AS messages FROM res GROUP BY "user" """))
def user_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.user_summary(results(spark, sf_dir)).select(
        "user", *r6("avg_risk", "max_risk"), "messages")


@query("user_profile", O.q(O.RESULTS, """
    SELECT "user", count(*) AS messages, round(avg(risk_score), 4) AS avg_risk,
      round(max(risk_score), 4) AS max_risk,
      count(*) FILTER (WHERE risk_band = 'High') AS high_count,
      count(*) FILTER (WHERE risk_band = 'Medium') AS med_count,
      count(*) FILTER (WHERE risk_band = 'Low') AS low_count, """ + ", ".join(
    f"round(avg({f}), 4) AS {f}" for f in fixed.FEATURES) + ' FROM res GROUP BY "user"'))
def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = K.user_profiles(results(spark, sf_dir))
    flat = [F.col("feature_profile")[label_of(f)].alias(f) for f in fixed.FEATURES]
    return profiles.select("user", "messages", "avg_risk", "max_risk", "high_count",
                           "med_count", "low_count", *flat)


def _card_columns() -> list:
    contribs = [F.col("contributions")[label_of(f)].alias(f"c_{f}") for f in fixed.FEATURES]
    return ["msg_id", "user", "text", "risk_score", "risk_band", "band_color", "top_driver", *contribs]


_COLORS = " ".join(f"WHEN '{b}' THEN '{c}'" for b, c in fixed.BAND_COLORS.items())
_CARD_SQL = f"""msg_id, "user", text, round(risk_score, 4) AS risk_score, risk_band,
    CASE risk_band {_COLORS} ELSE '{fixed.UNKNOWN_BAND_COLOR}' END AS band_color,
    {O.label('top_risk_driver')} AS top_driver, """ + ", ".join(
    f"round(contrib_{f}, 4) AS c_{f}" for f in fixed.FEATURES)


@query("user_top10_cards", O.q(O.RESULTS, f"""
    SELECT {_CARD_SQL}, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (
      PARTITION BY "user" ORDER BY risk_score DESC, msg_id) AS rank FROM res) WHERE rank <= 10"""))
def user_top10_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.user_cards(results(spark, sf_dir)).select(*_card_columns(), "rank")


@query("detail_cards", O.q(O.RESULTS, f"""
    SELECT {_CARD_SQL} FROM (SELECT * FROM res ORDER BY risk_score DESC, msg_id LIMIT 5)"""))
def detail_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_cards(results(spark, sf_dir)).select(*_card_columns())


@query("distinct_dims", O.q(O.RESULTS, """
    SELECT DISTINCT 'driver' AS dim, top_risk_driver AS value FROM res
      WHERE risk_score BETWEEN 0.4 AND 1.0
    UNION ALL SELECT DISTINCT 'user', "user" FROM res"""))
def distinct_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_rows = results(spark, sf_dir)
    return R.distinct_dims(ResultFilter(min_risk=0.4).apply(all_rows), all_rows)


@query("exec_summary", O.q(O.RESULTS, f"""
    SELECT count(*) FILTER (WHERE risk_band = 'High') AS high_count,
      round(count(*) FILTER (WHERE risk_band = 'High') / count(*)::DOUBLE * 100, 1) AS high_pct,
      (SELECT {O.label('top_risk_driver')} FROM res GROUP BY top_risk_driver
       ORDER BY count(*) DESC, top_risk_driver LIMIT 1) AS top_driver,
      (SELECT "user" FROM res GROUP BY "user" ORDER BY avg(risk_score) DESC, "user" LIMIT 1) AS top_user,
      (SELECT round(max(m), 3) FROM (SELECT avg(risk_score) AS m FROM res GROUP BY "user")) AS top_user_risk,
      round(avg(risk_score), 4) AS avg_risk, count(*) AS total_messages FROM res"""))
def exec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.executive_summary(results(spark, sf_dir))


_PAGE_NUMBERS = ", ".join(f"round({c}, 4) AS {c}" for c in ["risk_score", *fixed.FEATURES])


@query("top_messages_page", O.q(O.RESULTS, f"""
    SELECT msg_id, "user", text, risk_band, top_risk_driver, {_PAGE_NUMBERS} FROM (
      SELECT * FROM (SELECT * FROM res WHERE risk_score BETWEEN 0.1 AND 1.0
                     ORDER BY risk_score DESC, msg_id LIMIT 60)
      ORDER BY risk_score DESC, msg_id LIMIT 30 OFFSET 20)"""))
def top_messages_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.message_page(results(spark, sf_dir), WIDE)


@query("page_meta", O.q(O.RESULTS, """
    SELECT 20::BIGINT AS "offset", 30::BIGINT AS "limit", n AS total_filtered,
      least(greatest(n - 20, 0), 30)::BIGINT AS returned, 50 < n AS has_more
    FROM (SELECT least(count(*), 60) AS n FROM res WHERE risk_score BETWEEN 0.1 AND 1.0)"""))
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_meta(results(spark, sf_dir), WIDE)


@query("sorted_results", O.q(O.RESULTS, f"""
    SELECT msg_id, {r6_sql('risk_score')} FROM res ORDER BY risk_score DESC, msg_id"""))
def sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sorted_results(results(spark, sf_dir)).select("msg_id", *r6("risk_score"))


@query("console_report", O.q(O.RESULTS, """
    SELECT "user", format('{:.2f}', risk_score) AS risk_score, top_risk_driver AS top_driver
    FROM (SELECT * FROM res ORDER BY risk_score DESC, msg_id LIMIT 20)"""))
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.console_report(results(spark, sf_dir).select(
        "msg_id", "user", "risk_score", "top_risk_driver"))


@query("hist_bins", O.q(O.RESULTS, """
    SELECT bin, risk_band, count(*) AS count, round(bin / 20.0::DOUBLE, 4) AS bin_start FROM (
      SELECT least(floor(risk_score * 20), 19)::INTEGER AS bin, risk_band FROM res)
    GROUP BY bin, risk_band"""))
def hist_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.histogram(results(spark, sf_dir))


@query("score_density", O.q(O.RESULTS, """
    SELECT x, round(avg(exp(-0.5::DOUBLE * ((x - s) / 0.05::DOUBLE) * ((x - s) / 0.05::DOUBLE))
      / (0.05::DOUBLE * sqrt(2 * pi()))), 6) AS density
    FROM (SELECT risk_score AS s FROM res),
         (SELECT unnest(range(101)) / 100.0::DOUBLE AS x) GROUP BY x"""))
def score_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.density(results(spark, sf_dir)).select("x", *r6("density"))


@query("score_median", O.q(O.RESULTS, """
    SELECT 'median' AS line, round(median(risk_score), 6) AS at FROM res
    UNION ALL SELECT 'Med/Low', 0.4::DOUBLE UNION ALL SELECT 'High/Med', 0.7::DOUBLE"""))
def score_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.score_lines(results(spark, sf_dir)).select("line", *r6("at"))


@query("band_share", O.q(O.RESULTS, """
    SELECT b AS risk_band, count(msg_id) AS count,
      round(count(msg_id) / (SELECT count(*) FROM res)::DOUBLE * 100, 1) AS pct,
      b || '  ' || format('{:.1f}', round(count(msg_id) / (SELECT count(*) FROM res)::DOUBLE * 100, 1)) || '%' AS label
    FROM (VALUES ('Low'), ('Medium'), ('High')) v(b) LEFT JOIN res ON risk_band = b GROUP BY b"""))
def band_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.band_share(results(spark, sf_dir))


@query("driver_share", O.q(O.RESULTS, f"""
    SELECT top_risk_driver, {O.label('top_risk_driver')} AS label, count(*) AS count,
      round(count(*) / (SELECT count(*) FROM res)::DOUBLE * 100, 1) AS pct
    FROM res GROUP BY top_risk_driver"""))
def driver_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.driver_share(results(spark, sf_dir))


@query("contrib_heatmap", O.q(O.RESULTS + """,
  top15 AS (SELECT * FROM res ORDER BY risk_score DESC, msg_id LIMIT 15)""", " UNION ALL ".join(
    f"""SELECT msg_id, "user", '{label_of(f)}' AS feature, round(contrib_{f}, 6) AS contribution
    FROM top15""" for f in fixed.FEATURES)))
def contrib_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.contribution_heatmap(results(spark, sf_dir)).select(
        "msg_id", "user", "feature", *r6("contribution"))


@query("user_scatter", O.q(O.RESULTS, """
    SELECT "user", round(avg(risk_score), 6) AS avg_risk, count(*) AS messages,
      round(max(risk_score), 6) AS max_risk, avg(risk_score) >= 0.5 AS labelled
    FROM res GROUP BY "user" """))
def user_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.user_scatter(results(spark, sf_dir)).select(
        "user", *r6("avg_risk", "max_risk"), "messages", "labelled")


@query("feature_correlation", O.q(O.RESULTS, """
    SELECT feature_a, feature_b, c AS correlation, abs(c) AS abs_corr,
           coalesce(abs(raw) >= 0.3, false) AS shown
    FROM (SELECT feature_a, feature_b, raw, round(raw, 6) AS c FROM (
      SELECT feature_a, feature_b, CASE WHEN isnan(r) THEN NULL ELSE r END AS raw FROM (""" +
    " UNION ALL ".join(
        f"SELECT '{label_of(a)}' AS feature_a, '{label_of(b)}' AS feature_b, corr({a}, {b}) AS r FROM res"
        for a in fixed.FEATURES for b in fixed.FEATURES) + ")))"))
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.feature_correlation(results(spark, sf_dir)).select(
        "feature_a", "feature_b", *r6("correlation", "abs_corr"), "shown")


@query("user_boxplot", O.q(O.RESULTS + """,
  top12 AS (SELECT "user", avg(risk_score) AS mean FROM res GROUP BY "user"
            ORDER BY mean DESC, "user" LIMIT 12)""", """
    SELECT "user", round(min(risk_score), 6) AS min, round(quantile_cont(risk_score, 0.25), 6) AS q1,
      round(median(risk_score), 6) AS median, round(quantile_cont(risk_score, 0.75), 6) AS q3,
      round(max(risk_score), 6) AS max, round(avg(risk_score), 6) AS mean
    FROM res WHERE "user" IN (SELECT "user" FROM top12) GROUP BY "user" """))
def user_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.user_boxplot(results(spark, sf_dir)).select(
        "user", *r6("min", "q1", "median", "q3", "max", "mean"))


@query("feature_means", O.q(O.RESULTS, " UNION ALL ".join(
    f"SELECT '{label_of(f)}' AS feature, round(avg({f}), 4) AS mean_score FROM res"
    for f in fixed.FEATURES)))
def feature_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.feature_means(results(spark, sf_dir))


BOARD = ResultFilter(min_risk=0.1, text_query="the")
_BOARD = O.RESULTS + """,
  board AS MATERIALIZED (SELECT * FROM res WHERE risk_score BETWEEN 0.1 AND 1.0 AND contains(upper(text), 'THE'))"""


def board(spark: SparkSession, sf_dir: str) -> Board:
    return Board(results(spark, sf_dir), BOARD)


@query("dashboard_kpis", O.q(_BOARD, f"""
    SELECT count(*) AS messages, (SELECT count(*) FROM res) AS total, count(DISTINCT "user") AS users,
      round(avg(risk_score), 4) AS avg_risk, round(max(risk_score), 4) AS max_risk, round(median(risk_score), 4) AS median_risk,
      round(coalesce(stddev_samp(risk_score), 0), 4) AS std_risk, {_COUNTS} FROM board"""))
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).kpis()


@query("dashboard_groups", O.q(_BOARD, f"""
    SELECT 'histogram' AS dataset, bin || ' ' || risk_band AS key, count(*)::DOUBLE AS value, round(bin / 20.0::DOUBLE, 4) AS more FROM (
      SELECT least(floor(risk_score * 20), 19)::INTEGER AS bin, risk_band FROM board) GROUP BY bin, risk_band
    UNION ALL SELECT 'band', b, count(msg_id), round(count(msg_id) / (SELECT count(*) FROM board)::DOUBLE * 100, 1)
      FROM (VALUES ('Low'), ('Medium'), ('High')) v(b) LEFT JOIN board ON risk_band = b GROUP BY b
    UNION ALL SELECT 'driver', {O.label('top_risk_driver')}, count(*), round(count(*) / (SELECT count(*) FROM board)::DOUBLE * 100, 1)
      FROM board GROUP BY top_risk_driver
    UNION ALL SELECT 'mean', name, round(value, 4), NULL FROM (""" + " UNION ALL ".join(
    f"SELECT '{label_of(f)}' AS name, avg({f}) AS value FROM board" for f in fixed.FEATURES) + ")"))
def dashboard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram, bands, drivers and feature means of one filter, all from one table of facts."""
    b = board(spark, sf_dir)

    def part(name: str, df: DataFrame, key, value: str, more) -> DataFrame:
        return df.select(F.lit(name).alias("dataset"), key.alias("key"), F.col(value).cast("double").alias("value"), more.alias("more"))

    none = F.lit(None).cast("double")
    return part("histogram", b.histogram(), F.concat_ws(" ", "bin", "risk_band"), "count", F.col("bin_start")).unionByName(
        part("band", b.bands(), F.col("risk_band"), "count", F.col("pct"))).unionByName(
        part("driver", b.drivers(), F.col("label"), "count", F.col("pct"))).unionByName(
        part("mean", b.feature_means(), F.col("feature"), "mean_score", none))


@query("dashboard_users", O.q(_BOARD, """
    SELECT "user", round(avg(risk_score), 4) AS avg_risk, round(max(risk_score), 4) AS max_risk, count(*) AS messages,
      count(*) FILTER (WHERE risk_band = 'High') AS high_count, avg(risk_score) >= 0.5 AS labelled FROM board GROUP BY "user" """))
def dashboard_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = board(spark, sf_dir)
    return b.users().join(b.user_scatter().select("user", "labelled"), "user")


@query("dashboard_summary", O.q(_BOARD, f"""
    SELECT count(*) FILTER (WHERE risk_band = 'High') AS high_count,
      round(count(*) FILTER (WHERE risk_band = 'High') / count(*)::DOUBLE * 100, 1) AS high_pct,
      (SELECT {O.label('top_risk_driver')} FROM board GROUP BY top_risk_driver
       ORDER BY count(*) DESC, top_risk_driver LIMIT 1) AS top_driver,
      (SELECT "user" FROM board GROUP BY "user" ORDER BY avg(risk_score) DESC, "user" LIMIT 1) AS top_user,
      (SELECT round(max(m), 3) FROM (SELECT avg(risk_score) AS m FROM board GROUP BY "user")) AS top_user_risk,
      round(avg(risk_score), 4) AS avg_risk, count(*) AS total_messages FROM board"""))
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).summary()
