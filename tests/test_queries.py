"""Every registered query against its SQL twin on the smallest data set."""
import os

import pytest

import __spark_entry__ as entry
import check

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    ok, note, _ = check.compare(
        spark, con, name, lambda *_: df, entry.oracle_sql().get(name), SF_DIR)
    assert ok, note
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        # the encoder is the one place for a Python model
        assert word not in plan or (word == "ArrowEvalPython" and name == "encoder_signal")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
