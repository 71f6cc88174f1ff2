"""Quality and toxicity classifiers: held-out accuracy, odd tables, determinism."""
import zlib

import pytest
from llm_cases import odd_rows, prose
from tellsign.llm import quality, toxicity

CASES = [
    (quality, "quality", lambda i: prose(i, 80), lambda i: "!! ".join(prose(i, 80).upper().split())),
    (toxicity, "toxic", lambda i: f"{prose(i, 40)} you silly clown {prose(i + 1, 40)}", lambda i: prose(i, 80)),
]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("module,label,one,zero", CASES)
def test_learns_and_agrees(spark, documents, module, label, one, zero):
    docs = documents([(i, one(i) if i % 2 else zero(i), "en", "a", 0) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], f"doc_id long, {label} int")
    model = module.fit(docs, labels)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert len(got) == 400 and all(0 <= s <= 1 for s in got.values())
    tested = [i for i in got if held_out(i)]
    assert sum((got[i] >= module.CUT) == bool(i % 2) for i in tested) >= 0.95 * len(tested)
    again = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
    assert again == got


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_tables(spark, odd, documents, module, label):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (4, 1), (None, 1), (99, 1), (8, 7)], f"doc_id long, {label} int")
    scores = module.score(odd, module.fit(odd, labels)).collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scores)
    empty = {r.score for r in scores if r.doc_id in (3, 4, 12)}
    assert len(empty) == 1
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r.score for r in module.score(odd, module.fit(odd, none)).collect()} == {0.5}
    assert module.score(documents([]), module.fit(documents([]), labels)).count() == 0


def test_rejected_rows_go(spark, clashing):
    model = quality.train([])
    assert quality.keep_good(clashing, model, 0.4).columns == clashing.columns
    assert quality.keep_good(clashing, model, 0.4).count() == len(odd_rows())
    assert quality.keep_good(clashing, model, 0.6).count() == 0
