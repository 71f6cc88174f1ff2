"""The divergence audit against plain counts, also with digests that many terms share."""
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from llm_cases import LOWER, SCHEMA, odd_rows, prose
from tellsign.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, ranks=200):
    docs = [(r[2] or "", r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        everywhere = sum(own.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q, p = shares(everywhere), {s: shares(c) for s, c in own.items()}
        for s, c in own.items():
            pairs = [(-sum((p[s][t] - p[o][t])**2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [(-((p[s][t] - q[t])**2 // q[t]), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:ranks])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def found(audit):
    return sorted(tuple(r) for r in audit.report().collect())


def corpus(n):
    rng = random.Random(8)
    words = {lang: prose(i, 500).split() + ["É" + lang, "漢字"] for i, lang in enumerate(("en", "fr", "de", ""))}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None])
        own = words[lang or ""]
        text = " ".join(rng.choice(own[rng.randrange(3) * 20:]) for _ in range(rng.randint(0, 80)))
        rows.append((i, text.title() if i % 5 == 0 else text, lang, rng.choice(["a", "b", "b", "c", None]), 0))
    return rows + [(n, "alone here", "de", "a", 0), (n + 1, "alone", "de", "b", 0), (n + 2, "", "de", "c", 0)]


@pytest.mark.parametrize("bits", [64, 7])
def test_audit_equals_brute_force(spark, documents, bits):
    """Seven bits make every digest stand for several terms."""
    rows = corpus(500)
    audit = divergence.Audit(documents(rows).repartition(5), bits=bits)
    want = brute(rows)
    assert found(audit) == want and any(r[2] == "pair" and r[0] == "de" and r[4] == 0 for r in want)
    assert audit.words.where("low <> high").count() == (0 if bits == 64 else audit.words.count())


def test_many_blocks_and_ties(spark, documents):
    """One cell a block; hundreds of equal values around the last rank."""
    rows = [(i, " ".join(f"t{'abcdefghij'[i % 10]}{'klmnopqrst'[j % 10]}{'uvwxyzabcd'[j // 10]}" for j in range(60)), "en", "ab"[i % 2], 0)
            for i in range(60)]
    audit = divergence.Audit(documents(rows).repartition(4))
    want = brute(rows)
    assert sorted(tuple(r) for r in audit.pairs(cells=1).selectExpr("lang", "source", "'pair'", "item", "value", "rank").collect()) == [
        r for r in want if r[2] == "pair"]
    assert found(audit) == want and sum(r[2] == "term" for r in want) == 400


def test_wide_shares(spark):
    """Counts whose products exceed 63 bits."""
    n, total = 2**61, 2**62
    got = spark.range(1).select(divergence._share(*[divergence.F.lit(x).cast("long") for x in (n, total, 7)])).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + 7)


def test_odd_rows(odd, clashing, documents, spark):
    want = brute(odd_rows())
    assert found(divergence.Audit(odd)) == want and found(divergence.Audit(clashing)) == want
    extra = odd.selectExpr("*", "1 AS term", "2 AS digest", "3 AS n", "4 AS split")
    assert found(divergence.Audit(extra)) == want
    assert found(divergence.Audit(documents([]))) == []
    only = spark.createDataFrame([(1, None, None, None, None)] * 3, SCHEMA)
    assert found(divergence.Audit(only)) == []


def test_flushes_of_a_task_add_up(monkeypatch):
    """Many slices and flushes: the same counts as a plain loop, strings and all."""
    monkeypatch.setattr(divergence, "SLICE", 300)
    monkeypatch.setattr(divergence, "FLUSH_ROWS", 200)
    rows = [(r[2] or "", hash(r[3]) % 7, r[1]) for r in corpus(200)]
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 60]), (pa.string(), pa.int64(), pa.string()))],
                               names=["lang", "sid", "text"]) for i in range(0, len(rows), 60)]
    n, docs, flushes = Counter(), Counter(), 0
    for out in divergence._counted(iter(batches), 64):
        flushes += 1
        for r in out.to_pylist():
            docs[r["lang"], r["term"]] += r["docs"]
            for s, k in zip(r["sids"], r["ns"]):
                n[r["lang"], s, r["term"]] += k
    want_n, want_docs = Counter(), Counter()
    for lang, s, text in rows:
        terms = TERM.findall(text.translate(LOWER))
        want_n.update((lang, s, t) for t in terms)
        want_docs.update((lang, t) for t in set(terms))
    assert flushes > 5 and n == want_n and docs == want_docs
