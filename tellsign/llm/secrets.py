"""Secret scans: fixed patterns and character Markov models.

Three patterns give the base spans.  Beyond them, every run of ``CANDIDATE`` characters is scored by
two first-order character Markov models, of random strings and of ordinary words: the log-likelihood
ratio is the sum over its character pairs.  Runs above ``LEAST_RATIO`` that meet no base span are secrets too.

The models are trained from labelled samples ``(value, secret)``.  The query labels them itself: what
the base patterns found are random strings (at most ``TRAIN_SECRETS`` distinct values), the words of at most
``TRAIN_DOCS`` documents without a base span are ordinary ones; of both, those with the least hash.  A model
is a table of 67 x 67 numbers, whatever the input, and becomes a constant of the plan.

Only DataFrame expressions are used: the places of matches come from the lengths of the matches and of what
lies between them.  A text is scanned once; later steps read the short table of spans.

Nulls and ties: a null text is an empty one.  Places are code points, ends exclusive.  Equal starts are
ordered by kind.  A row without an id is scanned like any other.
"""
from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.llm import common
from tellsign.llm.common import WORD_PATTERN, stored

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?)"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"^[A-Za-z0-9+/_=-]{4,}$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RATIO = 12.0
PRIOR = 20
TRAIN_SECRETS = 20_000
TRAIN_DOCS = 2_000
_STATES = len(ALPHABET)
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches in order; ``value`` is the text of ``group``."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.split(text, pattern, -1)
    parts = F.transform(F.arrays_zip(between, matches, values), lambda p: F.struct(
        p["0"].alias("gap"), p["1"].alias("match"), p["2"].alias("value")))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        stop = start + F.coalesce(F.length(part["match"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), part["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), _none().alias("found")), step)["found"]
    return F.filter(found, lambda s: s["value"].isNotNull())


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind.  Texts that cannot match are told by cheap tests first."""
    assign = F.when(text.contains("=") | text.contains(":"), F.filter(
        spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 8)).otherwise(_none())
    access = F.when(text.contains("AKIA"), spans(text, ACCESS, 1)).otherwise(_none())
    hexes = F.when(text.rlike(HEX), spans(text, HEX, 2)).otherwise(_none())
    return F.array_sort(F.concat(assign, access, hexes))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, base, runs``: the base spans and the candidate runs that meet none of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", base_spans(F.col("text")).alias("base"),
        F.when(F.col("text").rlike(CANDIDATE), spans(F.col("text"), CANDIDATE, 3)).otherwise(_none()).alias("runs"))
    return own.select("doc_id", "base", F.filter("runs", lambda r: ~F.exists("base", lambda b: (
        b["start"] < r["stop"]) & (r["start"] < b["stop"]))).alias("runs"))


def own_samples(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``value, secret``: labelled samples that the base patterns give."""
    secrets = found.select(F.explode("base.value").alias("value")).distinct().orderBy(
        F.xxhash64("value"), "value").limit(TRAIN_SECRETS)
    ids = found.where(F.size("base") == 0).select("doc_id").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select(
        F.explode(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))).alias("value")).where(
        F.col("value").rlike(WORD)).distinct()
    return secrets.withColumn("secret", F.lit(1)).unionByName(words.withColumn("secret", F.lit(0)))


def _codes(value: Column) -> Column:
    """The states of the characters of a value."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every character pair (row by first character).

    A pair's probability is its share among those with the same first character, drawn towards the
    share of the second character alone, which counts as ``PRIOR`` more pairs.
    """
    codes = samples.where(F.length("value") > 1).select("secret", F.array_remove(_codes(F.col("value")), -1).alias("c"))
    pairs = codes.where(F.size("c") > 1).select("secret", F.explode(F.zip_with(
        F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1),
        lambda a, b: a * _STATES + b)).alias("pair"))
    counted = {(r[0], r[1]): r[2] for r in pairs.groupBy("secret", "pair").count().collect()}

    def logs(secret: int) -> list[float]:
        rows = [[counted.get((secret, a * _STATES + b), 0) for b in range(_STATES)] for a in range(_STATES)]
        ones = [sum(row[b] for row in rows) + 1 for b in range(_STATES)]
        return [math.log((row[b] + PRIOR * ones[b] / sum(ones)) / (sum(row) + PRIOR)) for row in rows for b in range(_STATES)]

    return [s - o for s, o in zip(logs(1), logs(0))]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a value: above zero it looks random."""
    table = F.from_json(F.lit(json.dumps([round(x, 5) for x in model])), "array<double>")

    def step(state: Column, code: Column) -> Column:
        more = F.when((state["last"] < 0) | (code < 0), 0.0).otherwise(
            F.element_at(table, (state["last"] * _STATES + code + 1).cast("int")))
        return F.struct(code.alias("last"), (state["sum"] + more).alias("sum"))

    return F.aggregate(_codes(value), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step)["sum"]


def joined(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``doc_id, base, added``: base spans and those that the models add, with their texts.

    ``samples`` (``value, secret``) trains the models; by default the base patterns label them.
    """
    found = stored(scanned(docs), "spans")
    model = train(own_samples(docs, found) if samples is None else samples)
    return found.select("doc_id", "base", F.filter(
        "runs", lambda r: ratio(r["value"], model) > least_ratio).alias("added"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    number = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}")
              for k in range(3)]
    return found.select(
        "doc_id", *number, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
