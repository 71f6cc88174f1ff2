"""A set of keys as a bitmap of bounded size, to test rows where they are.

It can say yes for a key that is not in the set, never no for one that is.  So it may keep rows from moving, and whatever
passes is tested exactly afterwards.  The bitmap is a literal of the plan: 256 KB, for ten keys as for a billion.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 21
_BUCKET = 32768
#: Bits for each key of a bitmap that is a table, and the most of them (64 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 29


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(BITS)).cast("long")


def build(keys: DataFrame) -> bytes:
    """The bitmap of the numbers in the column ``key``."""
    slot = _slot(F.col("key"))
    parts = keys.groupBy(F.shiftright(slot, 15).alias("bucket")).agg(
        F.bitmap_construct_agg(slot % _BUCKET).alias("bits")).collect()
    out = bytearray(max(BITS, _BUCKET) // 8)
    for part in parts:
        at = part["bucket"] * _BUCKET // 8
        out[at:at + _BUCKET // 8] = part["bits"]
    return bytes(out)


def may_hold(bitmap: bytes, key: Column) -> Column:
    slot = _slot(key)
    byte = F.substring(F.lit(bitmap), F.shiftright(slot, 3).cast("int") + 1, F.lit(1))
    return F.getbit(F.ascii(F.decode(byte, "ISO-8859-1")), (slot % 8).cast("int")) == 1


def _wide_slot(key: Column, n: int) -> Column:
    bits = max(BITS, min(MOST_BITS, 1 << (max(n, 1) * BITS_PER_KEY - 1).bit_length()))
    return F.pmod(key, F.lit(bits)).cast("long")


def table(keys: DataFrame, n: int) -> DataFrame:
    """The bitmap of some ``n`` numbers in the column ``key`` as a table of buckets, as large as the keys need."""
    # dealt by bucket before they are set, so that no task holds more than its buckets
    slots = keys.select(_wide_slot(F.col("key"), n).alias("_slot")).select(
        F.shiftright("_slot", 15).alias("_bucket"), (F.col("_slot") % _BUCKET).alias("_at")).repartition("_bucket")
    return slots.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def kept(rows: DataFrame, key: Column, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose ``key`` may be among some ``n`` numbers in the column ``key`` of ``keys``.

    For sets too large for a literal: the bitmap is a broadcast table.
    """
    return held_by(rows, key, table(keys, n), n)


def held_by(rows: DataFrame, key: Column, bitmap: DataFrame, n: int) -> DataFrame:
    """The rows whose ``key`` may be among the ``n`` numbers of which ``bitmap`` is the table."""
    marked = rows.withColumn("_slot", _wide_slot(key, n)).withColumn("_bucket", F.shiftright("_slot", 15))
    byte = F.substring("_bits", F.shiftright(F.col("_slot") % _BUCKET, 3).cast("int") + 1, F.lit(1))
    held = F.getbit(F.ascii(F.decode(byte, "ISO-8859-1")), (F.col("_slot") % 8).cast("int")) == 1
    return marked.join(F.broadcast(bitmap), "_bucket").where(held).drop("_slot", "_bucket", "_bits")
