import os

import pytest
from pyspark.sql import functions as F

from tellsign.operators import clean as C
from tellsign.operators import triage as TR
from tellsign.operators.filters import ResultFilter
from tellsign.sources import exports as X
from tellsign.sources import files as FI
from tellsign.sources import store


def put(folder, name, data, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode(encoding))
    return path


def load(spark, path, **kw):
    return C.valid_messages(FI.read_messages(spark, path, **kw)).dropDuplicates(["user", "text"])


def pairs(df):
    return sorted((r["user"], r["text"]) for r in df.collect())


def test_clean_fixture(spark, folder):
    path = put(folder, "m.txt", "m1;\tfirst text\nm2;second\nm1;first text \n;no user\nno text;\nm2;second\nm2;third\n")
    assert pairs(load(spark, path)) == [("m1", "first text"), ("m2", "second"), ("m2", "third")]
    keyed = C.with_message_id(FI.read_messages(spark, path))
    assert keyed.select("msg_id").distinct().count() == 3


def test_empty_and_missing(spark, folder):
    for text in ("", " ; \n;\n\n"):
        path = put(folder, f"e{len(text)}.txt", text)
        with pytest.raises(ValueError, match="empty"):
            C.require_rows(load(spark, path))
    with pytest.raises(Exception):
        FI.read_messages(spark, f"{folder}/missing.txt").count()


def test_encodings_are_chosen_per_file(spark, folder):
    put(folder, "a.txt", "m1;à côté du café\n", "latin-1")
    put(folder, "b.txt", "m2;für 5 €\n")
    assert pairs(load(spark, folder)) == [("m1", "à côté du café"), ("m2", "für 5 €")]


def test_quotes_breaks_rejects_and_null_tokens(spark, folder):
    path = put(folder, "m.txt",
               'a;"x; ""y"""\nb;"two\nlines"\nc;one;more\nd\nbob;NA\nz;null\n'
               "李;你好\ne;" + "a" * 50_000 + "\n")
    got = pairs(load(spark, path))
    assert [u for u, _ in got] == ["a", "b", "e", "李"]
    assert dict(got)["a"] == 'x; "y"' and dict(got)["b"] == "two\nlines" and len(dict(got)["e"]) == 50_000
    counts = FI.file_report(spark, path).first()
    assert (counts["kept"], counts["incomplete"], counts["rejected"]) == (6, 0, 2)


def whole_file(spark, path):
    """Records as a reader sees them that takes each file as a whole."""
    return spark.read.schema(FI.RECORD).options(**FI.OPTIONS).option("multiLine", True).csv(path)


@pytest.mark.parametrize("block", ["64", "1000", "100m"])
def test_split_files_equal_whole_files(spark, folder, block):
    """Blocks of 64 bytes cut records, quotes and breaks anywhere; the records are those of whole files."""
    import random

    rng = random.Random(5)
    fields = ["x", "", '"a;b"', '"two\nlines"', '"""q"""', '"\n\n"', '"say ""hi""\nthen ""go"""', '5" disk', '"ab"c', '"a"b"', "é漢",
              '"x\n""', '";\n;"', '"long ' + "word " * 40 + '\nend"', '"' + "\n" * 30 + '"']
    fields.remove('"x\n""')  # never closed: tested below
    for name in ("a", "b"):
        rows = [f"u{i};{rng.choice(fields)}" + rng.choice(["", "", "", ";z"]) for i in range(300)]
        put(folder, f"{name}.txt", "\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        tasks = FI._lines(spark, folder).rdd.getNumPartitions()
        got = sorted(map(str, FI.read_lines(spark, folder).drop("file").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(map(str, whole_file(spark, folder).collect()))
    assert tasks > 100 if block == "64" else tasks >= 1


def test_an_open_quote_ends_with_its_file(spark, folder):
    put(folder, "a.txt", 'a;x\nb;"open\nc;y\n')
    put(folder, "b.txt", "d;z\n")
    got = {(r.user, r.text) for r in FI.read_lines(spark, folder).collect()}
    assert {("a", "x"), ("d", "z")} < got and len(got) == 3


def test_long_records_without_broadcast(spark, folder, monkeypatch):
    monkeypatch.setattr(FI, "MOST_BROADCAST", -1)
    put(folder, "a.txt", 'a;"x\r\ny"\r\nb;plain\r\n')
    put(folder, "b.txt", 'c;"é\nà"\n', "latin-1")
    assert pairs(FI.read_messages(spark, folder)) == [("a", "x\r\ny"), ("b", "plain"), ("c", "é\nà")]


def test_texts_are_scanned_once_and_not_shuffled(spark, folder):
    put(folder, "a.txt", 'a;"x\ny"\nb;plain\n')
    plan = FI.read_lines(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    single = plan[:plan.index("Aggregate")]
    assert "Sort" not in single and plan.count("strategy=broadcast") == 4


def test_file_round_trip(spark, folder, messages):
    rows = [("a", 'x; "y"\nz'), ("b", " spaced "), ("c", "back\\slash")]
    FI.write_messages(messages(*rows), f"{folder}/out")
    assert sorted((r["user"], r["text"]) for r in FI.read_messages(spark, f"{folder}/out").collect()) == sorted(rows)


def test_cleaning_report(messages):
    df = messages(("a", "x"), ("a", " x "), ("a", "x"), (" ", "y"), ("b", ""), ("b", "x"))
    assert C.cleaning_report(df).first().asDict() == {
        "loaded": 6, "empty_dropped": 2, "duplicates_removed": 2, "kept": 2}
    kept = C.clean_messages(df)
    assert sorted(r["msg_id"] for r in kept.collect()) == [0, 5]
    none = C.cleaning_report(df.filter("msg_id < 0")).first()
    assert none["loaded"] == 0 and none["kept"] == 0


def test_exports(spark, folder, scored):
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    rows = scored.select("user", "text", "risk_score", "risk_band", "top_risk_driver")
    X.export_results(rows, f"{folder}/all", now, "weights.json")
    meta = spark.read.json(f"{folder}/all/meta").first()
    assert (meta["records"], meta["weights"], meta["generated"]) == (6, "weights.json", "2024-01-01T12:00:00Z")
    back = X.read_export(spark, f"{folder}/all/data", rows.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    X.export_filtered(rows, ResultFilter(min_risk=0.5), f"{folder}/some", now)
    meta = spark.read.json(f"{folder}/some/meta").first()
    assert (meta["records"], meta["total"], meta["min_risk"]) == (4, 6, 0.5)
    X.export_users(rows, f"{folder}/users")
    users = X.read_export(spark, f"{folder}/users", "user string, avg_risk double, max_risk double, messages long")
    assert users.count() == 6


def test_snapshots(spark, folder, scored):
    root = f"{folder}/queue"
    assert store.read_snapshot(spark, root) is None
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert store.write_snapshot(TR.sync(TR.empty_queue(spark), scored, now), root) == 1
    queue = store.read_snapshot(spark, root)
    assert store.write_snapshot(TR.delete_items(queue, queue.filter("user = 's72'")), root) == 2
    assert store.read_snapshot(spark, root).count() == 2
    assert store.read_snapshot(spark, root, 1).count() == 3
    os.makedirs(f"{root}/version=3")  # a write that never finished
    assert store.snapshot_versions(spark, root) == [1, 2]
    assert store.write_snapshot(queue, root) == 4 and store.snapshot_versions(spark, root) == [1, 2, 4]


def test_log_append_tail_and_trim(spark, folder):
    for i in range(5):
        store.append_log(spark.createDataFrame([(i, f"a{i}")], "id long, action string"), f"{folder}/log")
    tail = store.load_log(spark, f"{folder}/log", "id", 3).collect()
    assert [r["id"] for r in tail] == [2, 3, 4]
    assert store.trim_log(spark, f"{folder}/log", f"{folder}/log2", "id", 2).count() == 2
