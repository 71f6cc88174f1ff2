"""Exact quantiles against numpy, also where nearly all values share a bin."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from tellsign.operators.quantiles import exact_quantiles

PROBS = {"q0": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.9, "q4": 1.0}


def check(got, values):
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-12)


@pytest.mark.parametrize("make", [
    lambda r, n: r.random(n), lambda r, n: np.full(n, 0.3), lambda r, n: 0.5 + r.random(n) * 1e-9, lambda r, n: r.integers(0, 3, n) / 2,
    lambda r, n: r.normal(0.5, 2, n), lambda r, n: np.where(r.random(n) < 0.9, 0.7 + r.random(n) * 1e-6, r.random(n))])
def test_quantiles_equal_numpy(spark, make):
    rng = np.random.default_rng(3)
    for n in (1, 2, 1001):
        values = make(rng, n).astype(float)
        df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
        check(exact_quantiles(df, "v", PROBS).first(), values)


def test_keys_nulls_and_weights(spark):
    rows = [("a", 0.1, 3), ("a", 0.9, 1), (None, 0.5, 2), (None, None, 9), ("b", None, 1), ("c", 0.2, 1)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    plain = {r.k: r.m for r in exact_quantiles(df, "v", {"m": 0.5}, ["k"]).collect()}
    assert plain == pytest.approx({"a": 0.5, None: 0.5, "c": 0.2})
    heavy = {r.k: r.m for r in exact_quantiles(df, "v", {"m": 0.5}, ["k"], weight="n").collect()}
    assert heavy == pytest.approx({"a": 0.1, None: 0.5, "c": 0.2})
    assert exact_quantiles(df.where("false"), "v", {"m": 0.5}).first() is None or exact_quantiles(
        df.where("false"), "v", {"m": 0.5}).first().m is None


def test_a_crowded_bin_is_many_small_groups(spark):
    """A million values in one of the first bins: no shuffle sees more than the bins, and the answer is exact."""
    df = spark.range(1_000_000).select((F.lit(0.25) + F.col("id") / 1e6 * 2e-4).alias("v"))
    got = exact_quantiles(df, "v", {"m": 0.5})
    assert got.first().m == pytest.approx(0.25 + 499_999.5 / 1e6 * 2e-4, abs=1e-15)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_v" not in plan
