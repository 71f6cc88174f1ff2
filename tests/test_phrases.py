"""Phrase tables against regular expressions of the same phrases."""
import random
import time
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F
from tellsign import session
from tellsign.functions import bitmap
from tellsign.functions import text as T
from tellsign.operators import evidence as EV
from tellsign.operators import phrases as P
from tellsign.operators.clean import valid_messages
from tellsign.plans import scoring
from tellsign.plans.jobs import score_and_store, stored_features
from tellsign.plans.scoring import build_features, rescore, row_signals, score_batch
from tellsign.sources import lexicons as L

W = r"[\p{L}\p{N}_]"
GAP = r"[\s\x1c-\x1f]+"


def fold(text):
    return text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def python_hits(text, table):
    """(family, kind) to hits: one alternation a family, or one search a keyword."""
    out = Counter()
    for family in {f for _, f, k, _ in table if k == "regex"}:
        own = [p for _, f, k, p in sorted(table) if (f, k) == (family, "regex")]
        body = "|".join(GAP.join(fold(p).split(" ")) for p in own)
        out[family, "regex"] = len(regex.findall(f"(?<!{W})(?:{body})(?!{W})", fold(text)))
    for _, family, phrase in {(k, f, p) for _, f, k, p in table if k == "keyword"}:
        out[family, "keyword"] += len(regex.findall(f"(?<!{W}){phrase}(?!{W})", text.lower()))
    return {k: n for k, n in out.items() if n}


def random_table(rng, words, n):
    rows = [(i, rng.choice("xyz"), rng.choice(["regex", "keyword"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))))
            for i in range(n)]
    return list({(f, k, p): (i, f, k, p) for i, f, k, p in reversed(rows)}.values())


def test_random_tables_equal_regular_expressions(spark):
    rng = random.Random(11)
    words = ["a", "b", "ab", "is", "İs", "ſo", "n_1", "été", "漢字", "7"]
    gaps = [" ", " ", " ", "  ", "\t", "\n", "-", "", " ", "\x1c", "'"]
    for seed in range(3):
        table = random_table(rng, words, 60)
        texts = ["".join(rng.choice([w, w.upper()]) + rng.choice(gaps) for w in rng.choices(words, k=rng.randint(0, 30)))
                 for _ in range(400)] + [" ".join(["a"] * 50), ""]
        df = spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string").repartition(3)
        got = {}
        for r in P.family_hits(df, spark.createDataFrame(table, L.SCHEMA)).collect():
            got.setdefault(r.msg_id, {})[r.family, r.kind] = r.hits
        assert got == {i: h for i, t in enumerate(texts) if (h := python_hits(t, table))}


def test_bitmap_lets_too_much_through_but_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(bitmap, "BITS", 1 << 15)
    table = [(i, "f", "keyword", f"w{i} x") for i in range(30_000)]
    df = spark.createDataFrame([(1, "w17 x, w29999 x w40000 x"), (2, "w17  x")], "msg_id long, text string")
    got = P.spans(df, spark.createDataFrame(table, L.SCHEMA)).collect()
    assert sorted((r.msg_id, r.phrase, r.start) for r in got) == [(1, "w17 x", 0), (1, "w29999 x", 2)]


def test_evidence_counts_each_phrase(spark):
    df = spark.createDataFrame([(1, "As agreed: as  agreed, ASAP. bloccato BLOCCATO"), (2, "ıt is")], "msg_id long, text string")
    fixed = L.fixed_phrases(spark)
    want = {(1, "commitment", "regex", "as agreed", 2), (1, "commitment", "keyword", "as agreed", 1), (1, "urgency", "regex", "asap", 1),
            (1, "urgency", "keyword", "asap", 1), (1, "fear", "regex", "bloccato", 2), (1, "fear", "keyword", "bloccato", 2),
            (2, "authority", "regex", "it", 1)}
    assert {tuple(r) for r in EV.hit_evidence(df).collect()} == want
    assert {tuple(r) for r in P.evidence(df, fixed).select("msg_id", "family", "kind", "phrase", "hits").collect()} == want


def test_refused_rows(spark):
    rows = [(0, "f", "regex", "good one"), (1, "f", "regex", "two  blanks"), (2, "f", "other", "x"), (3, None, "regex", "x"),
            (4, "f", "keyword", None), (5, "f", "keyword", "don't"), (6, "f", "regex", ""), (7, "f", "regex", "Good one"), (8, "f", None, "x")]
    table = spark.createDataFrame(rows, L.SCHEMA)
    assert {r.ord for r in P.refused(table).collect()} == {1, 2, 3, 4, 5, 6, 8}
    assert [(r.ord, r.run) for r in P.usable(table).collect()] == [(0, "good one")]
    many = spark.range(P.MAX_FAMILIES + 1).selectExpr("id AS ord", "concat('f', id) AS family", "'regex' AS kind", "'x' AS phrase")
    with pytest.raises(ValueError, match="families"):
        P.families(many)


def test_empty_table_and_messages(spark, messages):
    none = spark.createDataFrame([], L.SCHEMA)
    df = messages(("a", "now"), ("b", "x"))
    assert P.family_hits(df, none).count() == 0
    assert "risk_score" in score_batch(df, phrases=none).columns
    assert P.family_hits(df.where("false"), L.fixed_phrases(spark)).count() == 0


def test_added_family_is_scored_stored_and_rescored(spark, messages, folder):
    table = L.fixed_phrases(spark).unionByName(spark.createDataFrame([
        (900, "greed", "regex", "easy money"), (901, "greed", "keyword", "jackpot"), (902, "greed", "keyword", "money")], L.SCHEMA))
    table.write.parquet(f"{folder}/phrases")
    phrases = L.read_phrases(spark, f"{folder}/phrases")
    rows = messages(("a", "Easy\tmoney now"), ("b", "jackpot jackpot money"), ("c", "nothing of it"))
    weights = {"urgency_score": 1.0, "greed_score": 3.0}
    results = score_and_store(rows, f"{folder}/results", weights=weights, phrases=phrases)
    got = {r.user: r for r in results.collect()}
    assert [got[u].greed_score for u in "abc"] == [1.0, 3.0, 0.0] and got["a"].urgency_score == 1.0
    assert got["b"].risk_score == pytest.approx(0.75) and got["b"].top_risk_driver == "greed_score"
    plain = {r.user: r for r in build_features(rows).collect()}
    for name in ("authority_score", "fear_score", "trust_score", "analyzer_urgency_score"):
        assert [got[u][name] for u in "abc"] == [plain[u][name] for u in "abc"]
    features = stored_features(results)
    assert "greed_score" in features.columns and "risk_score" not in features.columns
    patterns = build_features(rows, analyzer=False, phrases=phrases)
    assert {r.user: r.greed_score for r in patterns.collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert rescore(features, {"urgency_score": 1.0}).where("user = 'a'").first().risk_score == pytest.approx(1 - 2.718281828459045**-1)


def test_csv_table_needs_its_columns(spark, folder):
    spark.createDataFrame([(1, "f", "regex", "x y")], L.SCHEMA).write.option("header", True).csv(f"{folder}/c")
    assert L.read_phrases(spark, f"{folder}/c", "csv", header="true").first().phrase == "x y"
    spark.range(3).write.parquet(f"{folder}/p")
    with pytest.raises(ValueError, match="lacks"):
        L.read_phrases(spark, f"{folder}/p")


def test_texts_are_not_shuffled_for_the_table(spark, messages):
    """Only places of hits move; the message side of the last join is read where it is."""
    df = valid_messages(messages(("a", "now"), ("b", "x")))
    plan = P.family_hits(df, L.fixed_phrases(spark))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "text" not in above and "words" not in above.replace("words#", "")
    assert T.WORD in plan and F is not None


def test_a_table_too_large_to_broadcast_gives_the_same_places(spark, messages, monkeypatch):
    """Runs are tested by the broadcast bitmap before they are joined; all kinds of gaps and lengths."""
    rows = messages(("a", "act now, act  now; Act\tnow act-now"), ("b", "please act now or never act"), ("c", "nothing"), ("d", "İct now"))
    phrases = spark.createDataFrame(
        [(1, "f", "regex", "act now"), (2, "f", "keyword", "act now"), (3, "g", "regex", "act"), (4, "g", "keyword", "act now or never")],
        "ord long, family string, kind string, phrase string")

    def found():
        return sorted(tuple(r) for r in P.spans(rows, phrases).collect())

    expect = found()
    assert [r[5] for r in expect if r[0] == 0 and r[2] == "regex" and r[4] == "act now"] == [0, 2, 4]
    assert [r[5] for r in expect if r[0] == 0 and r[2] == "keyword"] == [0]
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    assert found() == expect


def test_bitmap_grows_with_its_keys(spark):
    """A fixed bitmap of 2**21 bits lets a fifth of the strange keys pass here."""

    def numbers(start, end):
        return spark.range(start, end).select(F.xxhash64("id").alias("key"))

    keys, n = numbers(0, 500_000), 500_000
    assert bitmap.kept(numbers(0, n), F.col("key"), keys, n).count() == n
    assert bitmap.kept(numbers(n, 2 * n), F.col("key"), keys, n).count() < 0.08 * n


def test_evidence_joins_a_table_of_moderate_size_where_the_texts_are(spark, messages):
    """By the number of phrases, not by Spark's estimate of their bytes."""
    phrases = spark.createDataFrame([(1, "f", "regex", "act")], "ord long, family string, kind string, phrase string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = P.evidence(messages(("a", "act now"), ("b", "act and act")), phrases)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in df.select("msg_id", "hits").collect()) == [(0, 1), (1, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scoring_works_out_the_phrase_table_once(spark, messages):
    """The table is a plan that may be costly; families and hits read what was written of it."""
    calls = spark.sparkContext.accumulator(0)

    def phrase(i):
        calls.add(1)
        return "act now"

    source = spark.range(1).select(F.col("id").alias("ord"), F.lit("f").alias("family"), F.lit("regex").alias("kind"),
                                   F.udf(phrase, "string").asNondeterministic()("id").alias("phrase"))
    assert row_signals(messages(("a", "act now")), phrases=source).first()["f_score"] == 1.0
    assert calls.value == 1


def test_large_tables_take_the_messages_in_slices(spark, messages, monkeypatch):
    """One slice at a time is on disk; what is returned are written counts, the same as of one piece."""
    rows = messages(*[("u", f"act now or never {i} act now, act") for i in range(40)], ("a", ""), ("b", "nothing")).unionByName(
        spark.createDataFrame([(None, "n", "act now")], "msg_id long, user string, text string"))
    phrases = spark.createDataFrame(
        [(1, "f", "regex", "act now"), (2, "f", "keyword", "act now"), (3, "g", "regex", "act"), (4, "f", "regex", "Act now")], L.SCHEMA)
    slices, counts = [], P.written

    def written(df, purpose):
        slices.append(purpose)
        return counts(df, purpose)

    def sides():
        return [sorted(map(str, f(rows, phrases).collect())) for f in (P.family_hits, P.evidence)]

    monkeypatch.setattr(P, "written", written)
    expect = sides()
    assert slices == ["phrases"] * 2
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    monkeypatch.setattr(P, "SLICE_BYTES", 1)
    monkeypatch.setattr(P, "SLICES", 2)
    assert sides() == expect and slices.count("phrase-hits") == 2 * P.SLICES
    assert "Generate" not in P.family_hits(rows, phrases)._jdf.queryExecution().optimizedPlan().toString()


def test_shuffle_files_of_a_written_table_go(spark):
    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")

    before, setting = files(), spark.conf.get(session.TIDY_KEY)
    df = session.written(spark.range(50_000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).count(), "tidy")
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before and df.count() == 1000 and spark.conf.get(session.TIDY_KEY) == setting


def test_scores_prepare_a_large_table_once_and_attach_vectors_last(spark, messages, monkeypatch):
    """The slices read the texts again, so nothing that moves texts may stand below them."""
    rows = messages(("a", "act now"), ("b", "act and act"), ("c", "nothing"))
    vectors = spark.createDataFrame([(0, [1.0, 1.0]), (2, [0.0, 3.0])], "msg_id long, embedding array<double>")
    phrases = spark.createDataFrame([(1, "f", "regex", "act"), (2, "g", "keyword", "act now")], L.SCHEMA)
    weights = {"f_score": 1.0, "semantic_signal": 1.0}
    purposes, attached, write, attach = [], [], P.written, scoring.E.attach

    def written(df, purpose):
        purposes.append(purpose)
        return write(df, purpose)

    def attaching(df, embeddings):
        attached.append("f_score" in df.columns)
        return attach(df, embeddings)

    def scored():
        return {r.msg_id: (r.f_score, r.g_score, round(r.semantic_signal, 6), round(r.risk_score, 6)) for r in score_batch(
            rows, vectors, weights, phrases=phrases).collect()}

    expect = scored()
    assert expect[0][:3] == (1.0, 1.0, 1.0) and expect[1][:3] == (2.0, 0.0, 0.0) and expect[2][:3] == (0.0, 0.0, 0.707107)
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    monkeypatch.setattr(P, "written", written)
    monkeypatch.setattr(scoring.E, "attach", attaching)
    monkeypatch.setattr(P, "SLICES", 1)
    assert scored() == expect
    assert purposes == ["phrases", "phrase-bits", "phrase-hits"] and attached == [True]
