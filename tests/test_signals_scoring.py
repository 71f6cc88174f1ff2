import json
import math
import time

import pytest
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.functions import scoring as SC
from tellsign.functions import signals as SG
from tellsign.plans.jobs import score_and_store, stored_features
from tellsign.plans.scoring import build_features, rescore, score_batch, score_features
from tellsign.sources import embeddings as E
from tellsign.sources import weights as W

#: Two keywords of each family, and two messages with none.
SAMPLE = [(f"u{i}", f"{words[0]} and {words[1]}: case {i}") for i, words in enumerate(fixed.KEYWORDS.values())] + [
    (f"quiet{i}", "see you at lunch" + " tomorrow" * i) for i in range(2)]


def test_sample(messages, spark):
    first = score_batch(messages(*SAMPLE)).orderBy("msg_id").collect()
    again = score_batch(messages(*SAMPLE)).orderBy("msg_id").collect()
    assert len(first) == len(SAMPLE) and all(0 <= r["risk_score"] <= 1 for r in first)
    assert min(first, key=lambda r: r["risk_score"])["user"] == "quiet0"
    assert [round(r["risk_score"], 6) for r in first] == [round(r["risk_score"], 6) for r in again]
    for r in first:
        parts = [r[f"contrib_{f}"] for f in fixed.FEATURES]
        assert sum(parts) == pytest.approx(r["risk_raw"], abs=1e-12)
        assert r["top_risk_driver"] == fixed.FEATURES[parts.index(max(parts))]


def test_merge_takes_the_larger_count(messages):
    df = build_features(messages(("a", "return the favor"), ("b", "team already approved tutti"),
                                 ("c", "important quick urgent")))
    rows = {r["user"]: r for r in df.collect()}
    assert rows["a"]["reciprocity_score"] == 2
    assert rows["b"]["social_proof_score"] == 2
    assert (rows["c"]["urgency_score"], rows["c"]["analyzer_urgency_score"]) == (3, 3)


def test_length_signal(messages):
    one = build_features(messages(("a", "hello"))).first()
    assert one["text_length_signal"] == 0
    three = build_features(messages(("a", "x"), ("b", "xxx"), ("c", "xxxxx"), ("c", "xxxxx"))).collect()
    assert sorted(r["text_length_signal"] for r in three) == [0, 0.5, 1]


def test_without_analyzer(messages):
    row = build_features(messages(("a", "trust me, urgent, good important")), analyzer=False).first()
    assert (row["sentiment"], row["sentiment_risk_signal"], row["trust_score"]) == (0, 0, 0)
    assert row["urgency_score"] == 1


def test_vectors(spark):
    df = spark.createDataFrame(
        [(0, [0.1, 0.2]), (1, [0.4, 0.5]), (2, [3.0, 4.0]), (3, None), (4, [])],
        "msg_id long, v array<float>")
    got = df.select(SG.semantic_signal(F.col("v")).alias("s"), SG.unit_vector(F.col("v")).alias("u")).collect()
    assert all(0 <= r["s"] <= 1 for r in got) and got[3]["s"] == 0 and got[4]["s"] == 0
    assert got[0]["s"] == pytest.approx(0.3 / math.sqrt(2))
    assert math.hypot(*got[2]["u"]) == pytest.approx(1, abs=1e-5)
    bad = spark.createDataFrame([([1.0, float("nan")],)], "v array<double>")
    with pytest.raises(Exception, match="NaN or infinite"):
        bad.select(SG.unit_vector(F.col("v"))).collect()


def _features(spark, *rows):
    names = fixed.FEATURES
    data = [tuple(float(r.get(n, 0.0)) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))


def test_scores(spark):
    hot = {"urgency_score": 2, "authority_score": 1, "semantic_signal": .3, "text_length_signal": .6,
           "sentiment_risk_signal": .1, "trust_score": 1}
    cold = {"semantic_signal": .1, "text_length_signal": .2, "sentiment_risk_signal": .1}
    rows = SC.score(_features(spark, hot, cold, {}, dict.fromkeys(fixed.FEATURES, 1000))).collect()
    assert rows[0]["risk_score"] > rows[1]["risk_score"]
    assert rows[2]["risk_score"] == 0 and rows[2]["top_risk_driver"] == "urgency_score"
    assert 0.99 < rows[3]["risk_score"] <= 1
    only = SC.score(spark.createDataFrame([(1.0, 0.5)], "urgency_score double, authority_score double"))
    assert 0 < only.first()["risk_score"] < 1
    assert "top_risk_driver" not in SC.score(_features(spark, hot), explain=False).columns
    zero = SC.score(_features(spark, hot), dict.fromkeys(fixed.FEATURES, 0.0))
    assert zero.first()["risk_score"] == 0


def test_extra_weight_widens_the_divisor(spark):
    base = SC.score(_features(spark, {"urgency_score": 1})).first()
    wide = SC.score(_features(spark, {"urgency_score": 1}), {**fixed.DEFAULT_WEIGHTS, "extra": 1.0}).first()
    assert wide["contrib_extra"] == 0
    assert wide["risk_score"] == pytest.approx(base["risk_score"] / 2)


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3999, 0.4, 0.7, 1.0, 1.01, -0.1)], "x double")
    got = [r[0] for r in df.select(SC.risk_band(F.col("x"))).collect()]
    assert got == ["Low", "Low", "Medium", "High", "High", None, None]


def test_weights_file(spark, folder):
    def read(obj):
        path = f"{folder}/w{abs(hash(str(obj)))}.json"
        with open(path, "w") as f:
            json.dump(obj, f, indent=1)
        return W.read_weights(spark, path)

    backwards = dict(reversed(list(fixed.DEFAULT_WEIGHTS.items())))
    assert list(read(backwards)) == list(backwards)
    assert read({**fixed.DEFAULT_WEIGHTS, "more": 0.5})["more"] == 0.5
    for bad in ({"urgency_score": 1}, {**backwards, "fear_score": -1},
                {**backwards, "fear_score": float("inf")}):
        with pytest.raises(ValueError):
            read(bad)


def test_weight_updates():
    for bad in ({}, {"nope": 1}, {"fear_score": -1}, {"fear_score": 0}, {"fear_score": float("nan")}):
        with pytest.raises(ValueError):
            W.validate_update(bad)
    assert W.validate_update({"fear_score": 1}) == {"fear_score": 1.0}


def test_weight_report(spark):
    assert not W.weight_report(spark).first()["is_custom"]
    assert not W.weight_report(spark, dict(fixed.DEFAULT_WEIGHTS)).first()["is_custom"]
    assert W.weight_report(spark, {"fear_score": 1.0}).first()["is_custom"]


def test_stored_run_and_rescore(messages, folder):
    stored = score_and_store(messages(*SAMPLE), f"{folder}/run")
    fresh = {r["msg_id"]: r["risk_score"] for r in score_batch(messages(*SAMPLE)).collect()}
    assert {r["msg_id"]: r["risk_score"] for r in stored.collect()} == fresh
    same = score_features(stored_features(stored)).collect()
    assert {r["msg_id"]: r["risk_score"] for r in same} == fresh
    only = rescore(stored_features(stored), {"fear_score": 2.0}).collect()
    assert {r["user"]: r["risk_score"] > 0 for r in only}[f"u{list(fixed.KEYWORDS).index('fear')}"]
    assert {r["top_risk_driver"] for r in only} == {"fear_score"}


def test_encoder_runs_once_per_distinct_text(messages):
    def length_model():
        def predict(texts):
            import numpy as np

            return np.array([[len(t), 1.0] for t in texts], dtype="float32")

        return predict

    rows = messages(("a", "xx"), ("b", "xx"), ("c", "yyyy"))
    got = {r["msg_id"]: r["embedding"] for r in E.encode_distinct(rows, length_model).collect()}
    assert got[0] == got[1] and len(got) == 3
    assert math.hypot(*got[2]) == pytest.approx(1, abs=1e-5)
    with_vectors = score_batch(rows, E.encode_distinct(rows, length_model))
    assert with_vectors.filter("semantic_signal > 0").count() == 3


def test_sentiment_table_equals_literal(spark, messages):
    rows = messages(
        ("a", "not a very good day, GOOD"), ("b", "nothing here"), ("c", "good good bad; really bad error"), ("d", "x"))
    table = spark.createDataFrame(
        [(w, float(v)) for w, v in fixed.SENTIMENT_LEXICON.items()] + [("good", -5.0), (None, 1.0)], "word string, valence double")
    plain, joined = (
        {r["user"]: r["sentiment"] for r in SG.sentiment_columns(rows, lexicon).collect()} for lexicon in (None, table))
    assert joined.keys() == plain.keys() and all(abs(joined[u] - plain[u]) < 1e-12 for u in plain)
    assert plain["b"] == 0 and plain["a"] != 0


def test_sentiment_table_moves_sums_and_no_words(spark, messages, monkeypatch):
    """Whatever Spark guesses of the lexicon's size; in parts and by the shuffle for larger ones the sums are the same."""
    from tellsign.functions import sentiment as S

    rows = messages(("a", "very good plan, not good at all"), ("b", "bad bad plan"), ("c", "even so"))
    lexicon = spark.createDataFrame([("good", 2.0), ("good", 1.0), ("bad", -1.5), ("plan", 0.0), (None, 3.0), ("nil", None)], "word string, valence double")

    def sums():
        return {r.msg_id: round(r.valence, 9) for r in S.valence_sums(rows, lexicon).collect()}

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.valence_sums(rows, lexicon)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expect = sums()
    assert set(expect) == {0, 1} and expect[1] == -3.0
    monkeypatch.setattr(S, "PART_WORDS", 2)
    assert sums() == expect
    monkeypatch.setattr(S, "MOST_WORDS", 0)
    assert sums() == expect


def test_unit_vector_takes_the_norm_once(spark):
    """With the norm worked out for each component this takes minutes."""
    start = time.monotonic()
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("double")).alias("v")).select(
        SG.unit_vector(F.col("v")).alias("u")).first()
    assert row.u[0] == 1 / math.sqrt(sum(float(x) * x for x in range(1, 20_001)))
    assert time.monotonic() - start < 30
