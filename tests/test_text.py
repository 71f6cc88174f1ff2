"""Phrase counting, stripping and escaping, against plain Python where it can say."""
import random
import re

import pytest
from pyspark.sql import functions as F

from tellsign import fixed
from tellsign.functions import sentiment as S
from tellsign.functions import signals as SG
from tellsign.functions import text as T

HARD = [
    "nowü now éasap", "return the favor", "in return the favor", "team already approved",
    "all  colleagues all\ncolleagues all colleagues", "İT it ıt IT", "aſap ASAP ásap",
    "asap, asap; ASAP asap", "Now or never: IMMEDIATELY", "it's IT. it_ _it it2",
    "Il conto è bloccato, agisci subito", "An official note, confidential until Monday",
    "Legal action starts and the account suspended stays so", "as\x1cpromised as  promised",
    "already approved already done", "i helped you said", "", "you are the best", "NOW", "Kelvin K",
    "per favore favor favore", "dear friend dear colleague", "now now now,now;now",
]


def python_counts(text):
    out = {}
    for family, phrases in fixed.PATTERNS.items():
        pattern = "|".join(r"\b" + r"\s+".join(p.split(" ")) + r"\b" for p in phrases)
        out[f"re_{family}"] = len(re.findall(pattern, text, re.IGNORECASE))
    for family, words in fixed.KEYWORDS.items():
        low = text.lower()
        out[f"kw_{family}"] = sum(len(re.findall(rf"\b{re.escape(w)}\b", low)) for w in words)
    return out


def texts():
    rng = random.Random(7)
    phrases = sorted({p for t in (fixed.PATTERNS, fixed.KEYWORDS) for v in t.values() for p in v})
    gaps = [" ", "  ", "\n", ", ", "-", "_", " ", "x", "é", "'", " "]
    made = []
    for _ in range(600):
        parts = []
        for _ in range(rng.randint(1, 12)):
            p = rng.choice(phrases)
            p = rng.choice([p, p.upper(), p.title(), p.replace(" ", rng.choice(gaps))])
            parts += [p, rng.choice(gaps)]
        made.append("".join(parts))
    return HARD + made


def test_counts_equal_python(spark):
    rows = list(enumerate(texts()))
    df = SG.with_hit_counts(spark.createDataFrame(rows, "i int, text string"))
    for row in df.collect():
        got = {k: v for k, v in row.asDict().items() if k.startswith(("re_", "kw_"))}
        assert got == python_counts(row["text"]), row["text"]


def test_guarded_counts_equal_one_pass_counts(spark):
    rows = list(enumerate(texts()))
    df = SG.with_hit_counts(spark.createDataFrame(rows, "i int, text string"))
    fold, low = T.folded(F.col("text")), T.lowered(F.col("text"))
    wrong = None
    for f in fixed.PATTERNS:
        c = F.col(f"re_{f}") != T.pattern_hits(fold, f)
        wrong = c if wrong is None else wrong | c
    for f in fixed.KEYWORDS:
        wrong = wrong | (F.col(f"kw_{f}") != T.keyword_hits(low, f))
    assert df.filter(wrong).count() == 0


def test_groups_never_share_words():
    groups = T.disjoint_groups(fixed.KEYWORDS["reciprocity"])
    assert ["return the favor"] in groups and len(groups) == 2
    assert len(T.disjoint_groups(fixed.KEYWORDS["urgency"])) == 1
    with pytest.raises(ValueError):
        T.union_regex(["as agreed", "as agreed upon"])


def test_strip_and_length(spark):
    rows = [("  hi there\x1c\n",), (None,), ("\U0001f600ab",), ("a" * 50_000,)]
    got = spark.createDataFrame(rows, "t string").select(
        T.strip(F.col("t")).alias("s"), F.length(T.strip(F.col("t"))).alias("n")).collect()
    assert [r["s"] for r in got[:3]] == ["hi there", "", "\U0001f600ab"]
    assert [r["n"] for r in got] == [8, 0, 3, 50_000]
    space = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    assert sorted(fixed.WHITESPACE) == space


def test_html_escape(spark):
    text = "5 < 7 > 3 && \"quoted\" it's &lt; done"
    got = spark.createDataFrame([(text,)], "t string").select(T.html_escape(F.col("t"))).first()[0]
    import html

    assert got == html.escape(text, quote=True)


def test_search_is_literal_and_case_blind(spark):
    df = spark.createDataFrame([("100% sure",), ("100 sure",), ("A_B",)], "t string")
    hit = lambda q: df.filter(T.contains_ignore_case(F.col("t"), q)).count()
    assert (hit("0% S"), hit("a_b"), hit("%"), hit(".")) == (1, 1, 1, 0)


def test_sentiment(spark):
    rows = [("good",), ("not good",), ("very good",), ("GOOD, good",), ("nothing here",), ("",),
            ("good not",), ("no a b good",), ("no a b c good",), ("very bad",)]
    df = SG.sentiment_columns(spark.createDataFrame(rows, "text string"))
    got = {r["text"]: r["sentiment"] for r in df.collect()}
    squeeze = lambda s: s / (s * s + 15) ** 0.5
    expect = {"good": 1.9, "not good": 1.9 * -0.74, "very good": 2.193, "GOOD, good": 3.8,
              "nothing here": 0, "": 0, "good not": 1.9, "no a b good": 1.9 * -0.74,
              "no a b c good": 1.9, "very bad": -2.793}
    assert got == pytest.approx({k: squeeze(v) for k, v in expect.items()}, abs=1e-12)


def test_sentiment_takes_a_large_lexicon_and_checks_its_size(spark):
    lexicon = {f"word{i}": (i % 9) - 4.0 for i in range(3000)}
    df = SG.sentiment_columns(
        spark.createDataFrame([("word8 word17 word4",)], "text string"), lexicon)
    assert df.first()["sentiment"] == pytest.approx(8 / (64 + 15) ** 0.5)
    with pytest.raises(ValueError):
        S.valence_sum(F.col("w"), {f"w{i}": 1.0 for i in range(S.MAX_LEXICON + 1)})
