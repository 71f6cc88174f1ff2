"""The stages of the pipeline one after another: effects, odd and empty tables, clashing columns."""
import pytest
from llm_cases import CLASHES, SCHEMA, odd_rows, prose
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture
def sf_dir(spark, folder):
    """Labels that call noise bad, and one benchmark item."""
    labels = [(i, int(i % 2 == 0), 0) for i in range(1000, 1400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(77, 12)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def labelled():
    return [(i, prose(i, 60) if i % 2 == 0 else " ".join(f"{i * j % 97}#$%" for j in range(60)), "en", "abc"[i % 3], 0) for i in range(1000, 1400)]


def run(spark, df, sf_dir):
    out = [df]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/{name}-{len(out)}-{id(df)}"
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return dict(zip(["start", *[name for name, _ in corpus_pipeline.STAGES]], out))


def test_stages_take_effect(spark, sf_dir, documents):
    rows = labelled() + [(2000, prose(1000, 60) + " extra", "en", "a", 0), (2001, prose(1002, 60), "en", "b", 0),
                         (2002, f"{prose(500, 40)} {prose(77, 12)} {prose(501, 40)}", "en", "c", 0)]
    got = run(spark, documents(rows), sf_dir)
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in got.items()}
    bad = {i for i in range(1000, 1400) if i % 2}
    assert len(ids["quality"] & bad) <= 5 and len(ids["quality"] - bad) >= 200
    assert ids["near_duplicates"] == ids["quality"] - {2000, 2001}
    assert ids["benchmark"] == ids["near_duplicates"] - {2002}
    assert ids["mix"] <= ids["benchmark"] and ids["shard"] == ids["mix"]
    # equally large sources weigh 1, 2 and 3
    many = {r.source: r["count"] for r in got["mix"].groupBy("source").count().collect()}
    total = sum(many.values())
    assert all(abs(many[s] / total - w / 6) < 0.08 for s, w in zip("abc", (1, 2, 3)))
    copies = got["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 3 and got["shard"].count() == got["mix"].count()
    assert set(got["shard"].columns) > set(got["start"].columns) and {r.shard for r in got["shard"].collect()} <= set(range(16))


def test_stages_on_odd_and_clashing_tables(spark, sf_dir, documents):
    df = documents(odd_rows() + labelled()[:60])
    for name in CLASHES:
        if name != "shard":
            df = df.withColumn(name, df["lang"])
    got = run(spark, df, sf_dir)
    for name in ("quality", "near_duplicates", "benchmark", "mix"):
        assert got[name].columns == df.columns
    assert set(df.columns) < set(got["shard"].columns) and got["shard"].count() > 0


def test_stages_on_an_empty_table(spark, sf_dir):
    got = run(spark, spark.createDataFrame([], SCHEMA), sf_dir)
    assert all(df.count() == 0 for df in got.values())
