import math
import statistics

import pytest
from pyspark.sql import functions as F

from tellsign.operators import charts as CH
from tellsign.operators import kpi as K
from tellsign.operators import rank as R
from tellsign.operators.filters import ResultFilter, of_user
from tellsign.operators.quantiles import exact_quantiles


def users(df):
    return sorted(r["user"] for r in df.collect())


def test_filters(scored):
    f = lambda **kw: users(ResultFilter(**kw).apply(scored))
    assert f() == ["s12", "s30", "s55", "s72", "s85", "s95"]
    assert f(min_risk=0.72, max_risk=0.85) == ["s72", "s85"]
    assert f(bands=["Low", "Medium"]) == ["s12", "s30", "s55"]
    assert f(drivers=["authority_score"]) == ["s85"] and f(users=["s72", "s55"]) == ["s55", "s72"]
    assert f(text_query="S85 ASKS") == ["s85"] and f(text_query="   ") == f()
    assert f(text_query=" Item 2") == ["s72"]
    assert f(bands=[], users=[]) == f()
    assert f(users=["s55"] + [f"nobody{i}" for i in range(2000)]) == ["s55"]
    assert users(of_user(scored, "s72")) == ["s72"]


@pytest.mark.parametrize("bad", [
    {"min_risk": -0.1}, {"max_risk": 1.1}, {"text_query": "x" * 513}, {"top_n": 0},
    {"top_n": 1001}, {"offset": -1}, {"limit": 0}, {"limit": 501}])
def test_filter_bounds(bad):
    with pytest.raises(ValueError):
        ResultFilter(**bad)


@pytest.mark.parametrize("offset,limit,returned,more", [
    (0, 10, 10, True), (40, 100, 10, False), (100, 10, 0, False), (40, 10, 10, False)])
def test_paging(scaled_results, offset, limit, returned, more):
    spec = ResultFilter(top_n=50, offset=offset, limit=limit)
    rows = R.message_page(scaled_results(50), spec).collect()
    meta = R.page_meta(scaled_results(50), spec).first()
    assert len(rows) == returned == meta["returned"]
    assert meta["total_filtered"] == 50 and meta["has_more"] is more
    if rows:
        assert rows[0]["msg_id"] == 49 - offset


def test_pages_cover_the_capped_ranking(scaled_results):
    df = scaled_results(50)
    seen = []
    for offset in range(0, 40, 7):
        seen += [r["msg_id"] for r in R.message_page(df, ResultFilter(top_n=33, offset=offset, limit=7)).collect()]
    assert seen == list(range(49, 16, -1))


def test_kpis(scaled_results, scored):
    df = scaled_results(10)
    row = K.kpi_block(df, df).first()
    scores = [r["risk_score"] for r in df.collect()]
    assert row["median_risk"] == round(statistics.median(scores), 4)
    assert row["std_risk"] == pytest.approx(round(statistics.stdev(scores), 4))
    assert row["high"] + row["medium"] + row["low"] == 10 and row["total"] == 10
    one = scored.filter("user = 's55'")
    assert K.kpi_block(one, scored).first()["std_risk"] == 0
    assert K.kpi_block(scored.filter("user = 'x'"), scored).count() == 0
    snap = K.kpi_snapshot(df.withColumn("run_version", F.lit(3)), ["run_version"]).first()
    assert snap["messages"] == 10 and snap["run_version"] == 3


def test_summary_and_dims(scored):
    row = K.executive_summary(scored).first()
    assert (row["high_count"], row["top_user"], row["total_messages"]) == (3, "s95", 6)
    assert row["top_driver"] == "Authority"  # all drivers occur once: first by name
    dims = R.distinct_dims(scored.filter("risk_score > 0.8"), scored).collect()
    assert [tuple(r) for r in dims[:2]] == [("driver", "authority_score"), ("driver", "urgency_score")]
    assert len(dims) == 8


def test_cards(scored):
    cards = R.top_cards(scored.withColumn("contrib_fear_score", F.lit(0.12345)), 2).collect()
    assert [c["user"] for c in cards] == ["s95", "s85"]
    assert cards[0]["band_color"] == "#e41a1c" and cards[1]["top_driver"] == "Authority"
    assert cards[0]["contributions"] == {"Fear": 0.1235}
    assert R.console_report(scored, 0).collect()[0]["risk_score"] == "0.95"


def test_hot_user_sends_few_rows(spark):
    """The rank limit has a part before the shuffle, so a hot user is cut in every task."""
    df = spark.range(0, 5000).select(
        F.col("id").alias("msg_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("u"), F.col("id") % 50)).alias("user"), (F.col("id") / 5000).alias("risk_score"))
    top = R.top_rows_per_user(df, 10)
    assert top.groupBy("user").count().filter("count > 10").count() == 0
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("values", [
    [0.5], [0.1, 0.9], [0.3] * 7 + [0.4], [i / 997 for i in range(500)], [0.0, 1.0, 1.0],
    [0.25 + i * 1e-9 for i in range(101)]])
def test_quantiles_are_exact(spark, values):
    rows = [("a" if i % 3 else "b", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.99, "q4": 1.0}
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("p")).first()["p"]
    got = exact_quantiles(df, "v", probs).first()
    assert [got[n] for n in probs] == pytest.approx(want, abs=1e-12)
    per_key = {r["k"]: r["q2"] for r in exact_quantiles(df, "v", {"q2": 0.5}, ["k"]).collect()}
    for k in per_key:
        assert per_key[k] == pytest.approx(statistics.median([v for x, v in rows if x == k]), abs=1e-12)


def test_quantiles_outside_the_bin_range(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, -1.0, 0.5, 7.0, 1e300)], "v double")
    got = exact_quantiles(df, "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()
    assert tuple(got) == (-5.0, 0.5, 1e300)


def test_charts(scored, scaled_results):
    df = scaled_results(41)
    assert sum(r["count"] for r in CH.histogram(df).collect()) == 41
    top = CH.histogram(df.withColumn("risk_score", F.lit(1.0))).collect()
    assert {r["bin"] for r in top} == {19}
    area = CH.density(df, bandwidth=0.02).agg(F.sum("density") / 100).first()[0]
    assert area == pytest.approx(1, abs=0.02)
    share = {r["risk_band"]: r for r in CH.band_share(scored.filter("risk_band <> 'Medium'")).collect()}
    assert share["Medium"]["count"] == 0 and share["High"]["label"] == "High  60.0%"
    assert [r["line"] for r in CH.score_lines(df).collect()] == ["median", "Med/Low", "High/Med"]
    empty = CH.band_share(scored.filter("user = 'x'")).collect()
    assert [r["pct"] for r in empty] == [0, 0, 0]


def test_correlation_of_constant_features_is_null(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 0.3) for i in range(20)],
                               "urgency_score double, trust_score double, liking_score double")
    got = {(r["feature_a"], r["feature_b"]): r for r in CH.feature_correlation(df).collect()}
    assert got["Urgency", "Trust"]["correlation"] == pytest.approx(1)
    assert got["Urgency", "Liking"]["correlation"] is None and not got["Liking", "Liking"]["shown"]
    assert not math.isnan(got["Trust", "Trust"]["correlation"])
