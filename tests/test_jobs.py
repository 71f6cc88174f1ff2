import datetime as dt

import pytest
from pyspark.sql import functions as F

from tellsign.__main__ import main
from tellsign.operators.filters import ResultFilter
from tellsign.operators import triage as T
from tellsign.plans.dashboard import dashboard
from tellsign.plans.jobs import full_run, update_queue
from tellsign.plans.scoring import score_batch
from tellsign.session import SHUFFLE_KEY, estimated_bytes, partitions_for, sized_shuffles
from tellsign.sources import store

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOT = ("URGENT now immediately: as the IT admin and director, everyone everybody already approved. "
       "Trust this official secure confidential note. Return the favor in return. As promised, as agreed, "
       "dear friend. Breach, penalty, legal action.")


def test_runs_and_commands(spark, folder, messages):
    full_run(messages(("alice", HOT), ("bob", "hello"), ("bob", "hello")), folder, 1, T0)
    full_run(messages(("carl", HOT), ("bob", "hi")), folder, 2, T0 + dt.timedelta(hours=1))
    queue = {r["user"]: r for r in store.read_snapshot(spark, f"{folder}/queue").collect()}
    assert set(queue) == {"alice", "carl"} and not queue["alice"]["present_in_latest_run"]
    timeline = store.load_log(spark, f"{folder}/kpi_timeline", "run_version", 200).collect()
    assert [(r["run_version"], r["messages"], r["high"]) for r in timeline] == [(1, 2, 1), (2, 2, 1)]
    full_run(messages(("carl", HOT), ("bob", "hi")), folder, 2, T0 + dt.timedelta(hours=1))
    assert store.load_log(spark, f"{folder}/kpi_timeline", "run_version", 200).count() == 2
    cmds = spark.createDataFrame(
        [(1, [queue["carl"]["id"], "who"], T0 + dt.timedelta(hours=2), "mitigated", None, "done"),
         (2, ["who"], T0, "bogus", None, None)],
        "cmd_id long, item_ids array<string>, cmd_ts timestamp, status string, assignee string, note string")
    out = update_queue(spark, folder, cmds)
    assert {r["user"]: r["status"] for r in out["queue"].collect()} == {"alice": "new", "carl": "mitigated"}
    assert [r["item_id"] for r in out["not_found"].collect()] == ["who"] and out["refused"].count() == 1
    log = store.load_log(spark, f"{folder}/audit_log", "id", 500).collect()
    assert [r["action"] for r in log] == ["triage_status", "triage_note"]
    with pytest.raises(ValueError, match="empty"):
        full_run(messages((" ", "x")), folder, 2, T0)
    assert spark.read.parquet(f"{folder}/results/run=2").count() == 2


def test_audit_rows_survive_a_crash(spark, folder, messages, monkeypatch):
    """A job that dies before the snapshot leaves no entries, one that dies after it leaves them for the next."""
    full_run(messages(("alice", HOT), ("bob", "hello")), folder, 1, T0)
    item = store.read_snapshot(spark, f"{folder}/queue").first()["id"]

    def command(i, status):
        return spark.createDataFrame([(i, item, T0, status, None, None)], "cmd_id long, item_id string, cmd_ts timestamp, "
                                     "status string, assignee string, note string")

    def dies(*_, **__):
        raise RuntimeError("executor lost")

    for name, version in (("write_snapshot", 1), ("append_log", 2)):
        with monkeypatch.context() as m:
            m.setattr(store, name, dies)
            with pytest.raises(RuntimeError):
                update_queue(spark, folder, command(version, "mitigated"))
        assert store.snapshot_versions(spark, f"{folder}/queue")[-1] == version
    update_queue(spark, folder, command(3, "new"))
    log = store.load_log(spark, f"{folder}/audit_log", "id", 500).collect()
    assert [r["details"].split(": ")[1] for r in log] == ["new -> mitigated", "mitigated -> new"]
    assert store.numbers(spark, f"{folder}/queue_changes", "version") == []


def test_upsert_items(spark, scored):
    queue = T.sync(T.empty_queue(spark), scored, T0)
    one = queue.filter("user = 's72'").withColumn("assignee", F.lit("zoe"))
    rows = {r["user"]: r["assignee"] for r in T.upsert_items(queue.filter("user <> 's85'"), one).collect()}
    assert rows == {"s95": "", "s72": "zoe"}


def test_dashboard(spark, messages, folder):
    rows = messages(("alice", HOT), ("bob", "hello there"), ("carl", "urgent: the manager needs this now"))
    score_batch(rows).write.parquet(f"{folder}/r")
    results = spark.read.parquet(f"{folder}/r")
    got = {name: df.collect() for name, df in dashboard(results).items()}
    assert got["kpis"][0]["messages"] == 3 and got["total"][0]["total"] == 3
    assert len(got["correlation"]) == 121 and len(got["weights"]) == 11 and len(got["bands"]) == 3
    assert [r["user"] for r in got["messages"]][0] == "alice" and len(got["detail_cards"]) == 3
    frames = dashboard(results, ResultFilter(text_query="nowhere to be found"))
    assert all(frames[name].count() == 0 for name in ("kpis", "users", "summary", "messages", "histogram", "drivers"))
    assert [(r["risk_band"], r["count"]) for r in frames["bands"].collect()] == [("Low", 0), ("Medium", 0), ("High", 0)]


def test_dashboard_scans_once_for_all_groups(spark, messages, folder):
    """The grouped datasets read the facts only, and equal those of the plain operators."""
    from tellsign.operators import charts, kpi
    from tellsign.plans.dashboard import Board

    score_batch(messages(*[(f"u{i % 3}", f"{HOT if i % 4 == 0 else 'urgent now'} {i}") for i in range(40)])).write.parquet(f"{folder}/r")
    results = spark.read.parquet(f"{folder}/r")
    board = Board(results)
    for own, plain in ((board.histogram(), charts.histogram(results)), (board.bands(), charts.band_share(results)),
                       (board.drivers(), charts.driver_share(results)), (board.users(), kpi.user_ranking(results)),
                       (board.user_scatter(), charts.user_scatter(results)), (board.feature_means(), charts.feature_means(results))):
        assert sorted(own.select(*plain.columns).collect()) == sorted(plain.collect())
        assert f"{folder}/r" not in own._jdf.queryExecution().executedPlan().toString()


def test_command_line(folder, capfd, spark):
    with open(f"{folder}/m.txt", "w") as f:
        f.write(f"alice;{HOT}\nbob;hello\n")
    main([f"{folder}/m.txt", "--top", "1"])
    out = capfd.readouterr().out
    assert "alice" in out and "bob" not in out


def test_shuffles_grow_with_the_input(spark, messages, folder):
    assert partitions_for(10, 200) == 200 and partitions_for(1 << 40, 200) == 4096
    assert partitions_for(100 << 40, 200) == 409_600
    messages(("a", "x")).write.parquet(f"{folder}/m")
    before = spark.conf.get(SHUFFLE_KEY)
    stored = spark.read.parquet(f"{folder}/m")
    assert 0 < estimated_bytes(stored) < 100_000
    assert estimated_bytes(spark.createDataFrame(stored.rdd, stored.schema)) is None
    with sized_shuffles(stored) as n:
        assert str(n) == spark.conf.get(SHUFFLE_KEY) == before
    assert spark.conf.get(SHUFFLE_KEY) == before
