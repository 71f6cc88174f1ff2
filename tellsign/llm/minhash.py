"""Near-duplicate groups: many universal hash minima, banding, verification, components.

Two documents are linked when the shingle sets of their whole texts have
``100 * |A & B| >= percent * |A | B|``.  The steps:

1. One pass over the texts gives every document its set size, a 128-bit digest of the set, 120
   minima of universal hashes and the 24 band keys of five minima each.
2. Documents with equal sets form a class (a map-side ``min``); only its smallest id goes on.
   A hot group of exact copies is one row from here.
3. In each bucket every member is paired with the smallest member only.  Pairs whose
   signatures agree too little are dropped, the rest is decided on the full shingle sets, and
   the links give components.  This is linear in the size of a group.
4. A link between two other members could still be missing, but only where these belong to different
   components.  In such buckets the members outside the largest component are compared with all, in
   pairs of blocks of about ``BLOCK`` texts, on the full sets too; only links are emitted.  So no candidate
   link is left out.

Two sets at the bound share a bucket with probability 1 - (1 - .85**5)**24 > 1 - 1e-6, more
similar ones more surely.  The signature bound lies five standard deviations below.

Nulls and ties: a null text is an empty one; documents without words are in no group but their
own.  Rows that share a ``doc_id`` are one document for the purpose of grouping.  A row with a null
id takes part under a stand-in; ``component_id`` is null only if no row of the group has an id.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellsign.llm import common
from tellsign.llm.common import fresh, stored
from tellsign.llm.graph import components

BANDS = 24
ROWS = 5
PERCENT = 85
BLOCK = 128
COLUMNS = 4096
STAND_IN = 1 << 62

_MULTIPLY = common.random_words(BANDS * ROWS, 11) | np.uint64(1)
_ADD = common.random_words(BANDS * ROWS, 12)
_BAND_SEED = common.random_words(BANDS, 13)

FINGERPRINT = "nid long, n_shingles long, digest binary, minima binary, bands array<long>"


def node_id(doc_id: Column, text: Column) -> Column:
    """The id, or a number above all ids made from the text where it is null."""
    other = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(doc_id.cast("long"), F.lit(STAND_IN) + other)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 32-bit minima for each (not empty) set."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    heads = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), len(_MULTIPLY)), dtype=np.uint32)
    hashed = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for j in range(len(_MULTIPLY)):
            np.multiply(flat, _MULTIPLY[j], out=hashed)
            np.add(hashed, _ADD[j], out=hashed)
            out[:, j] = np.minimum.reduceat(hashed, heads) >> np.uint64(32)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band; the band's number is part of it."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(_BAND_SEED, parts.shape[:2]).copy()
        for j in range(ROWS):
            key = common.mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return key.view(np.int64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in common.slices(batch.column(1)):
            sets = common.shingles(data, offsets)
            full = [i for i, s in enumerate(sets) if len(s)]
            digests, signs, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                own = minima([sets[i] for i in full])
                for i, sign, keys in zip(full, own, band_keys(own)):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    signs[i], bands[i] = sign.tobytes(), keys
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, end - first),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ], names=["nid", "n_shingles", "digest", "minima", "bands"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Set size, set digest, minima and band keys of every document."""
    return docs.select(node_id(docs["doc_id"], docs["text"]).alias("nid"), docs["text"]).mapInArrow(
        _fingerprint, FINGERPRINT)


def _agreeing(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.stack([np.frombuffer(x.as_py(), np.uint32) for x in batch.column(c)]) for c in (2, 3))
        keep = pa.array((a == b).sum(axis=1) >= least)
        yield batch.select([0, 1]).filter(keep)


def _sharing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (
            (s for _, _, data, offsets in common.slices(batch.column(c)) for s in common.shingles(data, offsets))
            for c in (2, 3))
        linked = []
        for a, b in zip(left, right):
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))


def least_agreement(percent: int) -> int:
    """Equal minima that a pair at the bound falls short of with probability below 1e-6."""
    s, n = percent / 100, BANDS * ROWS
    return max(0, int(n * s - 5 * (n * s * (1 - s)) ** 0.5))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose whole texts (``nid, text``) reach the bound, decided on full shingle sets."""
    one = pairs.join(texts.toDF("u", "text_u"), "u")
    two = one.join(texts.toDF("v", "text_v"), "v").select("u", "v", "text_u", "text_v")
    return two.mapInArrow(lambda it: _sharing(it, percent), "u long, v long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices of some thousand columns."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def _block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components within one block, or across two."""
    sets = [s for _, _, data, offsets in common.slices(pa.array(pdf["text"], pa.string()))
            for s in common.shingles(data, offsets)]
    both, sizes = shared_counts(sets), np.array([len(s) for s in sets])
    ids, comps = pdf["nid"].to_numpy(), pdf["comp"].to_numpy()
    linked = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
    u, v = np.nonzero(linked & (comps[:, None] != comps[None, :]) & (ids[:, None] > ids[None, :]))
    return pd.DataFrame({"u": ids[u], "v": ids[v]})


def _across(members: DataFrame, texts: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components that share a bucket, its leader left out.

    The strangers of a bucket, those outside its largest component, are dealt to blocks by a hash of
    their id, and so are the others.  A block of strangers meets every other block of the bucket; two blocks of
    the largest component need not meet.  No order within a bucket is needed, so no task gathers one.
    """
    labelled = members.where("nid <> leader").join(comps, F.col("nid") == comps["node"], "left").select(
        "bucket", "nid", F.coalesce("component", "nid").alias("comp"))
    counts = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("own"))
    mixed = counts.groupBy("bucket").agg(
        F.sum("own").alias("n"), F.max(F.struct("own", "comp")).alias("top"),
        F.count(F.lit(1)).alias("comps")).where("comps > 1").select(
        "bucket", F.col("top.comp").alias("largest"),
        F.ceil((F.col("n") - F.col("top.own")) / BLOCK).alias("strange"),
        F.ceil(F.col("top.own") / BLOCK).alias("plain"))
    stranger, spread = F.col("comp") != F.col("largest"), F.xxhash64("nid")
    block = F.when(stranger, F.pmod(spread, F.col("strange"))).otherwise(
        F.col("strange") + F.pmod(spread, F.col("plain")))
    last = F.col("strange") - 1 + F.when(stranger, F.col("plain")).otherwise(0)
    dealt = labelled.join(mixed, "bucket").withColumn("i", block).select(
        "bucket", "nid", "comp", "i",
        F.explode(F.array_remove(F.sequence(F.lit(0).cast("long"), last), F.col("i"))).alias("j"))
    return dealt.join(texts, "nid").groupBy(
        "bucket", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).applyInPandas(
        lambda pdf: _block_links(pdf, percent), "u long, v long").distinct()


def links(docs: DataFrame, marks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links ``u, v`` between class representatives; their components are complete."""
    least = least_agreement(percent)
    classes = marks.where("n_shingles > 0").groupBy("digest").agg(F.min("nid").alias("nid"))
    # rows that repeat with their id would multiply in the joins by id
    repeated = not marks.groupBy("nid").count().where("count > 1").isEmpty()

    def once(rows: DataFrame) -> DataFrame:
        return rows.dropDuplicates() if repeated else rows

    bands = once(marks.join(classes.select("nid"), "nid", "left_semi").select("nid", F.explode("bands").alias("bucket")))
    leaders = bands.groupBy("bucket").agg(F.min("nid").alias("leader"), F.max("nid").alias("other"))
    members = stored(
        bands.join(leaders.where("leader <> other").select("bucket", "leader"), "bucket"), "members")
    texts = stored(once(docs.select(node_id(docs["doc_id"], docs["text"]).alias("nid"), docs["text"])).join(
        members.select("nid").distinct().hint("merge"), "nid", "left_semi"), "texts")
    pairs = members.where("nid <> leader").select(F.col("nid").alias("u"), F.col("leader").alias("v")).distinct()
    signs = once(marks.select("nid", "minima"))
    near = pairs.join(signs.toDF("u", "sign_u"), "u").join(signs.toDF("v", "sign_v"), "v").select(
        "u", "v", "sign_u", "sign_v").mapInArrow(lambda it: _agreeing(it, least), "u long, v long").distinct()
    first = stored(verified(near, texts, percent), "links")
    return first.unionByName(stored(_across(members, texts, components(first), percent), "links"))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """``nid, n_shingles, component`` for every row of ``docs``."""
    marks = stored(fingerprints(docs), "fingerprints")
    found = links(docs, marks, percent)
    classes = marks.where("n_shingles > 0").groupBy("digest").agg(F.min("nid").alias("rep"))
    rows = stored(marks.select("nid", "n_shingles", "digest").join(classes, "digest", "left").select(
        "nid", "n_shingles", F.coalesce("rep", "nid").alias("rep")), "membership")
    shared = rows.groupBy("nid").agg(F.min("rep").alias("v"), F.max("rep").alias("most")).where("v <> most")
    same_id = rows.join(shared.select("nid", "v"), "nid").select(F.col("rep").alias("u"), "v")
    comps = components(found.unionByName(same_id))
    return rows.join(comps, rows["rep"] == comps["node"], "left").select(
        "nid", "n_shingles", F.coalesce("component", "rep").alias("component"))


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    return _grouped(docs, percent).select(
        F.when(F.col("nid") < STAND_IN, F.col("nid")).alias("doc_id"), "n_shingles",
        F.when(F.col("component") < STAND_IN, F.col("component")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group, with all columns of ``docs``.

    Of several rows with the id that stays, the one with the least text is taken.
    """
    groups = stored(_grouped(docs, percent), "groups")
    gone = groups.where("nid <> component").select("nid").distinct()
    repeated = groups.groupBy("nid").count().where("count > 1").select("nid")
    nid, row = fresh(docs, "nid"), fresh(docs, "row")
    keyed = docs.withColumn(nid, node_id(docs["doc_id"], docs["text"]))
    left = keyed.join(gone.withColumnRenamed("nid", nid).hint("merge"), nid, "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    several = repeated.withColumnRenamed("nid", nid)
    first = F.row_number().over(Window.partitionBy(nid).orderBy("text"))
    one = left.join(several, nid, "left_semi").withColumn(row, first).where(F.col(row) == 1).drop(row)
    return left.join(several, nid, "left_anti").unionByName(one).select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.documents(spark, sf_dir))
