"""Streams against the batch operators, and what happens when batches are delivered again."""
import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F
from tellsign.operators import triage as T
from tellsign.plans.scoring import score_batch
from tellsign.sources import store
from tellsign.streaming import queue as SQ
from tellsign.streaming import score as ST

DAY = dt.datetime(2024, 1, 1)


def feed(spark, folder, rows, files=3):
    df = spark.createDataFrame(rows, "msg_id long, user string, text string, ts timestamp")
    df.repartition(files, "msg_id").write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), df


def rows_of(n):
    texts = ["urgent: account suspended, trust the IT manager now", "dear friend, in return", "hello there you"]
    return [(i, f"u{i % 4}", f"{texts[i % 3]} {i}", DAY + dt.timedelta(hours=i)) for i in range(n)]


def scored_rows(spark, rows):
    """(msg_id, user, score, hour) as a scored stream has them."""
    data = [(i, u, f"text {u}", s, "High" if s >= 0.7 else "Low", "fear_score", DAY + dt.timedelta(hours=h)) for i, u, s, h in rows]
    return spark.createDataFrame(
        data, "msg_id long, user string, text string, risk_score double, risk_band string, top_risk_driver string, ts timestamp")


def test_stream_scores_equal_batch_scores(spark, folder):
    stream, batch = feed(spark, folder, rows_of(24))
    expect = score_batch(batch.drop("ts"))
    low, high = expect.agg(F.min("text_length"), F.max("text_length")).first()
    ST.write_stream(ST.score_stream(stream, (low, high)), f"{folder}/out", f"{folder}/ck").awaitTermination()
    got = {r["msg_id"]: r["risk_score"] for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {r["msg_id"]: r["risk_score"] for r in expect.collect()}


def test_window_kpis_are_exact(spark, folder):
    """Windows closed in several micro-batches; late rows fall out; users and medians as Python has them."""
    rows = [(i, f"u{i * i % 7}", round((i * 37 % 101) / 101, 9), i / 4) for i in range(200)]
    df = scored_rows(spark, rows)
    # one file for each 50 rows, in the order of time, and one row that is two days late
    for k in range(4):
        df.where(f"msg_id div 50 = {k}").coalesce(1).write.parquet(f"{folder}/in/part{k}")
    late = df.where("msg_id = 0").withColumn("user", F.lit("late"))
    late.coalesce(1).write.parquet(f"{folder}/in/part4")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    ST.kpi_stream(stream, f"{folder}/out", f"{folder}/ck", "6 hours", "1 hour").awaitTermination()
    got = {r.start: r for r in ST.read_kpis(spark, f"{folder}/out").collect()}
    assert sorted(got) == [DAY + dt.timedelta(hours=6 * i) for i in range(8)]
    for i in range(8):
        own = [r for r in rows if 6 * i <= r[3] < 6 * i + 6]
        k = got[DAY + dt.timedelta(hours=6 * i)]
        scores = [r[2] for r in own]
        assert (k.messages, k.users) == (len(own), len({r[1] for r in own}))
        assert k.median_risk == pytest.approx(statistics.median(scores), abs=6e-5)
        assert k.avg_risk == pytest.approx(statistics.mean(scores), abs=6e-5) and k.max_risk == pytest.approx(max(scores), abs=6e-5)
        assert (k.high, k.low, k.medium) == (sum(s >= 0.7 for s in scores), sum(s < 0.7 for s in scores), 0)


def test_closed_windows_weigh_equal_scores(spark):
    counts = spark.createDataFrame([(DAY, "a", 0.1, "Low", 5), (DAY, "b", 0.9, "High", 2), (DAY, "b", 0.5, "Medium", 1)],
                                   "start timestamp, user string, risk_score double, risk_band string, n long")
    k = ST.closed_kpis(counts).first()
    assert (k.messages, k.users, k.median_risk, k.high, k.medium, k.low) == (8, 2, 0.1, 2, 1, 5) and k.high_pct == 25.0
    assert ST.closed_kpis(counts.where("false")).count() == 0


def test_dedup_drops_repeats_within_the_delay(spark, folder):
    rows = rows_of(30)
    stream, _ = feed(spark, folder, rows + [(100 + r[0], *r[1:]) for r in rows[:5]], files=1)
    ST.write_stream(ST.dedup_stream(stream, "3 hours"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    got = spark.read.parquet(f"{folder}/out").collect()
    assert len(got) == 30 and len({(r.user, r.text) for r in got}) == 30


def test_queue_from_a_stream(spark, folder):
    stream, batch = feed(spark, folder, rows_of(24))
    scored, root = ST.score_stream(stream, (1, 100)), f"{folder}/queue"
    SQ.triage_stream(scored, root, f"{folder}/ck", 0.3).awaitTermination()
    key = SQ.stream_key(f"{folder}/ck")
    batches = store.numbers(spark, f"{root}/delta/stream={key}", "batch")
    first = {r.id: r for r in SQ.read_queue(spark, root).collect()}
    assert len(first) == 8 and len(batches) == 3
    assert all(r.present_in_latest_run and r.status == "new" and len(r.activity) == 1 for r in first.values())
    # nothing new: no further delta
    SQ.triage_stream(scored, root, f"{folder}/ck", 0.3).awaitTermination()
    assert store.numbers(spark, f"{root}/delta/stream={key}", "batch") == batches
    # the whole input again by another stream: the same items
    SQ.triage_stream(scored, root, f"{folder}/ck2", 0.3).awaitTermination()
    assert {r.id for r in SQ.read_queue(spark, root).collect()} == first.keys()


def as_rows(df):
    return sorted(map(str, df.select(*T.COLUMNS).collect()))


def test_deltas_equal_merging_each_batch(spark, folder):
    """Folding deltas gives what a merge of the whole queue after each batch would have given."""
    batches = [[(0, "a", 0.8, 1), (1, "b", 0.75, 2)], [(2, "a", 0.9, 5), (3, "a", 0.85, 4), (4, "c", 0.1, 9)], [(5, "d", 0.7, 7)]]
    state = T.empty_queue(spark)
    for i, rows in enumerate(batches):
        scored = scored_rows(spark, rows)
        SQ.write_delta(scored, f"{folder}/q", "s", i)
        hot = scored.where("risk_score >= 0.7")
        fresh = hot.withColumn("id", T.TF.message_id(F.col("user"), F.col("text"))).groupBy("id").agg(
            F.max_by(F.struct("user", "text", "risk_score", "risk_band", F.lit("Fear").alias("top_driver")), "msg_id").alias("m")
        ).select("id", "m.*")
        state = T.merge(state, fresh, F.lit(hot.agg(F.max("ts")).first()[0]), mark_stale=False)
    assert as_rows(SQ.read_queue(spark, f"{folder}/q")) == as_rows(state)
    # delivered twice: the same
    SQ.write_delta(scored_rows(spark, batches[1]), f"{folder}/q", "s", 1)
    assert as_rows(SQ.read_queue(spark, f"{folder}/q")) == as_rows(state)


def test_compaction_commands_and_redelivery(spark, folder):
    root = f"{folder}/q"
    first, second = scored_rows(spark, [(0, "a", 0.8, 1), (1, "b", 0.75, 2)]), scored_rows(spark, [(2, "a", 0.95, 5), (3, "c", 0.7, 6)])
    assert SQ.read_queue(spark, root).count() == 0
    SQ.write_delta(first, root, "s", 0)
    before = as_rows(SQ.read_queue(spark, root))
    assert SQ.compact(spark, root) == 1 and as_rows(SQ.read_queue(spark, root)) == before
    assert SQ.compact(spark, root) == 1
    commands = SQ.read_queue(spark, root).where("user = 'a'").select(
        F.lit(1).alias("cmd_id"), F.col("id").alias("item_id"), F.lit(DAY).alias("cmd_ts"), F.lit("in_progress").alias("status"),
        F.lit("kim").alias("assignee"), F.lit(None).cast("string").alias("note"))
    assert SQ.update(spark, root, commands) == 2
    # the batch of the base once more: ignored; the next one keeps what people did
    SQ.write_delta(first, root, "s", 0)
    SQ.write_delta(second, root, "s", 1)
    got = {r.user: r for r in SQ.read_queue(spark, root).collect()}
    assert (got["a"].status, got["a"].assignee, got["a"].risk_score) == ("in_progress", "kim", 0.95)
    assert [x.action for x in got["a"].activity] == ["created", "status", "assignee"] and set(got) == {"a", "b", "c"}
    # an unfinished delta and an unfinished base do not count
    hidden = scored_rows(spark, [(9, "z", 0.9, 9)])
    SQ.write_delta(hidden, root, "s", 2)
    store.remove(spark, f"{root}/delta/stream=s/batch=2/_SUCCESS")
    SQ.write_base(spark, root, T.empty_queue(spark), {"s": 9})
    store.remove(spark, f"{root}/base/version=3/through/_SUCCESS")
    assert {r.user for r in SQ.read_queue(spark, root).collect()} == {"a", "b", "c"}
    whole = as_rows(SQ.read_queue(spark, root))
    assert SQ.compact(spark, root) == 4
    SQ.expire(spark, root, keep=1)
    assert as_rows(SQ.read_queue(spark, root)) == whole
    assert store.numbers(spark, f"{root}/base", "version") == [4] and store.numbers(spark, f"{root}/delta/stream=s", "batch") == [2]


def test_a_batch_does_not_read_the_queue(spark, folder, monkeypatch):
    """The cost of a batch is its own: no base and no delta is looked at."""
    root = f"{folder}/q"
    SQ.write_delta(scored_rows(spark, [(0, "a", 0.8, 1)]), root, "s", 0)
    SQ.compact(spark, root)
    for name in ("_state", "_bases", "_deltas", "_through"):
        monkeypatch.setattr(SQ, name, lambda *_: pytest.fail("read the queue"))
    SQ.write_delta(scored_rows(spark, [(1, "b", 0.8, 2)]), root, "s", 1)


def test_snapshots_expire(spark, folder):
    df = spark.range(3)
    for _ in range(4):
        store.write_snapshot(df, f"{folder}/s")
    store.remove(spark, f"{folder}/s/version=2/_SUCCESS")
    assert store.expire_snapshots(spark, f"{folder}/s", keep=2) == [3, 4]
    assert store.numbers(spark, f"{folder}/s", "version") == [3, 4] and store.write_snapshot(df, f"{folder}/s") == 5


@pytest.fixture
def split_tables(spark, folder):
    """Tables whose documents are a folder of several files."""
    words = "urgent: account suspended, act now"
    docs = [(i, f"{words} {i // 2 if i < 4 else i}", "en", f"src{i % 2}", 40) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([(i, DAY + dt.timedelta(hours=i)) for i in range(40)], "event_id long, ts timestamp").coalesce(1).write.parquet(
        f"{folder}/events.parquet")
    spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(
        f"{folder}/embeddings.parquet")
    return folder


def test_dedup_reads_documents_that_are_a_folder(spark, split_tables):
    from tellsign.plans import queries_io

    assert queries_io.stream_dedup(spark, split_tables).count() == 40
