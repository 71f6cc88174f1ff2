"""What must hold for the plans, whatever the size of the input."""
import os
import re

import pytest
import __spark_entry__ as entry
from pyspark.sql import functions as F
from tellsign.operators import clean as C
from tellsign.operators.filters import ResultFilter
from tellsign.operators import kpi as K
from tellsign.plans.catalog import results
from tellsign.plans.scoring import score_batch
from tellsign.sources import files as FI
from tellsign.sources.embeddings import stored_embeddings
from tellsign.sources.tables import planted_messages

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df):
    """Columns that each exchange of texts carries, in the plan that ran."""
    df.collect()
    final = plan_of(df).split("\n+- == Initial Plan ==")[0]
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    detail = utils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange)\n(?:Output[^\n]*\n)?Input \[\d+\]: \[([^\]]*)\]", detail.split("Initial Plan")[0])
    return final, [i for i in inputs if re.search(r"\btext#", i)]


def big(monkeypatch):
    """Inputs count as larger than a split for each core."""
    monkeypatch.setattr(C, "estimated_bytes", lambda df: 1 << 50)


def test_scoring_a_table_moves_no_text(spark, monkeypatch):
    big(monkeypatch)
    raw = planted_messages(spark, SF_DIR)
    doubled = raw.unionByName(raw.withColumn("msg_id", F.col("msg_id") + 10_000))
    for df, vectors in ((raw, None), (doubled, stored_embeddings(spark, SF_DIR))):
        final, moved = exchanged(score_batch(df, vectors))
        assert moved == [] and "SortMergeJoin" not in final


def test_more_duplicates_than_can_be_broadcast(spark, monkeypatch):
    """Only rows that the bitmap does not clear are moved; the result is the same."""
    raw = planted_messages(spark, SF_DIR)
    doubled = raw.unionByName(raw.where("msg_id % 3 = 0").withColumn("msg_id", F.col("msg_id") + 10_000))
    want = sorted(r.msg_id for r in C.clean_messages(doubled).collect())
    monkeypatch.setattr(C, "MOST_BROADCAST", -1)
    big(monkeypatch)
    got = C.clean_messages(doubled)
    assert sorted(r.msg_id for r in got.collect()) == want == sorted(r.msg_id for r in C.clean_messages(raw).collect())
    assert "SortMergeJoin" in exchanged(got)[0]


def test_scoring_files_moves_the_text_once(spark, monkeypatch, folder):
    big(monkeypatch)
    FI.write_messages(planted_messages(spark, SF_DIR), f"{folder}/m")
    raw = C.with_message_id(FI.read_messages(spark, f"{folder}/m"))
    final, moved = exchanged(score_batch(raw, unique=True))
    assert len(moved) <= 2 and (len(moved) == 1 or "ReusedExchange" in final)


def test_filters_and_columns_reach_the_scan(spark):
    stored = results(spark, SF_DIR)
    spec = ResultFilter(min_risk=0.4, bands=["High"], users=["src1", "src2"])
    df = K.user_ranking(spec.apply(stored))
    utils = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    plan = utils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    assert "GreaterThanOrEqual(risk_score,0.4)" in pushed and "risk_band" in pushed and "user" in pushed
    assert re.search(r"ReadSchema: (\S+)", plan)[1] == "struct<user:string,risk_score:double,risk_band:string>"


def test_rank_limits_apply_before_the_shuffle(spark):
    for name in ("user_top10_cards", "preset_top", "triage_commands", "precision_at_k"):
        plan = plan_of(entry.queries()[name](spark, SF_DIR))
        assert re.search(r"WindowGroupLimit .*Partial", plan), name
