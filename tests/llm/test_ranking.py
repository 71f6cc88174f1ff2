"""Ranked search against a plain scoring of all pairs."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm_cases import LOWER, odd_rows, prose
from tellsign.llm import common, ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, words = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, n in own:
            m = 10 + (90 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **how):
    got = ranking.best_documents(docs, spark.createDataFrame(items, ITEMS), **how).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr)


def corpus(n, seed=3):
    rng = random.Random(seed)
    common_words = prose(seed, 400).split()
    out = []
    for i in range(n):
        words = [rng.choice(common_words) for _ in range(rng.randint(1, 120))] + [f"rare{rng.randint(0, n)}é"] * rng.randint(0, 2)
        rng.shuffle(words)
        out.append((i, rng.choice([" ", "-", " / "]).join(words).title() if i % 7 else " ".join(words)))
    return out + [(n + i, out[5][1]) for i in range(40)]


def test_ranking_equals_brute_force(spark, documents):
    docs = corpus(900)
    items = [(i, docs[i * 11][1][:150] + " never-heard-of") for i in range(60)] + [(100, "zzzz"), (101, ""), (102, None)]
    df = documents([(d, t, "en", "a", 0) for d, t in docs]).repartition(6)
    want = brute(docs, items)
    assert len(want) >= 550 and found(spark, df, items) == want
    assert found(spark, df, items, part_terms=200) == want
    assert found(spark, df, items[:3], k=3) == brute(docs, items[:3], 3)


def test_bounds_hold_and_save_work(monkeypatch):
    """With few coordinates as with many: no bound below its score, and most pairs are never rescored."""
    docs = corpus(1500)
    texts = pa.array([t for _, t in docs])
    item_terms = [np.unique(ranking.terms_of(*_one(" ".join(t.split()[:12])))[0]) for _, t in docs[:40]]
    names = np.concatenate([np.full(len(x), i) for i, x in enumerate(item_terms)])
    queries = ranking.Queries.collect(_Rows(names, np.concatenate(item_terms)))
    for size in (16, 1024):
        monkeypatch.setattr(ranking, "SKETCH", size)
        coordinate = (queries.terms % np.uint64(size)).astype(np.int64)
        best, pairs = ranking._Best(40, 10), 0
        for first, end, data, offsets in ranking._slices(texts):
            hashes, counts = ranking.terms_of(data, offsets)
            part = ranking._Slice(queries, np.full(len(queries.terms), 700), coordinate, hashes, counts, 1500, 90_000)
            bounds = part.bounds(0, 40)
            q, row = np.divmod(np.arange(40 * part.rows), part.rows)
            assert (bounds[q, row] >= part.exact(q, row)).all()
            pairs += ranking._rescore(part, best, np.arange(first, end), 0, 40, bounds)
        assert pairs < 40 * len(docs) * (1 if size == 16 else 0.2)


def _one(text):
    return next(common.slices(pa.array([text])))[2:]


class _Rows:
    def __init__(self, item, term):
        self.table = pa.table({"item": item, "term": term.view(np.int64)})

    def toArrow(self):
        return self.table


def test_odd_rows(spark, odd, clashing, documents):
    items = [(1, "one TWO"), (1, "one TWO"), (None, "été 漢字"), (2, prose(1, 8)), (2, prose(2, 3)), (3, "\U0001f600"), (4, " .,"), (5, None)]
    docs = [(r[0], r[1]) for r in odd_rows()]
    want = brute(docs, items)
    assert {r[0] for r in want} == {1, None, 2, 3}
    assert found(spark, odd, items) == want and found(spark, clashing, items) == want
    assert found(spark, documents([]), items) == [] and found(spark, odd, []) == []
    extra = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS item", "2 AS rank", "3 AS term")
    assert ranking.best_documents(odd, extra).count() == len(want)


def test_one_word_everywhere(documents, spark):
    """A term that all documents share, and equal scores of all."""
    docs = [(i, "same word here") for i in range(3000)]
    got = found(spark, documents([(d, t, "en", "a", 0) for d, t in docs]).repartition(5), [(7, "word")])
    assert got == brute(docs, [(7, "word")])


def test_partitions_of_terms(spark):
    counts = defaultdict(set)
    for r in ranking.query_terms(spark.createDataFrame([(1, "a b A"), (2, None), (3, "b")], "item long, text string")).collect():
        counts[r.item].add(r.term)
    assert len(counts[1]) == 2 and len(counts[3]) == 1 and counts[3] < counts[1] and 2 not in counts
