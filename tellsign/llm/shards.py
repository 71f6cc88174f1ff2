"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Every record is hashed by its id into one of ``SLOTS`` virtual slots, for good.  A map says which shard
each slot belongs to.  The first version deals slots in turn; rebalancing edits it with the bytes that
each slot holds: a shard keeps its slots as long as they fit into an equal share, and the slots above
that go, largest first, each to the shard with the least bytes so far.  So sizes come near equal
while most records stay where they were, and adding a shard moves only what the new one takes.

The map has ``SLOTS`` rows whatever the input (a proven bound, so it is broadcast and one task
may fold it); everything per record is an expression of that record and a narrow shuffle by virtual
slot for its place within the shard.  Texts are never moved.

Nulls and ties: a null text has no bytes (size 1) and a null checksum; a record without an id is hashed
by its text.  Equal rows share a virtual slot and get places one after another.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellsign.llm import common
from tellsign.llm.common import fresh, stored

SLOTS = 8192
SHARDS = 16


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), text, F.lit(""))), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot, bytes, rows`` of every virtual slot, also of empty ones."""
    filled = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(filled, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots in turn."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"),
        F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map: ``version, vslot, shard`` with near equal bytes."""
    held = slot_map.join(sizes.select("vslot", "bytes"), "vslot")
    filled = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    marked = held.withColumn("share", F.sum("bytes").over(Window.partitionBy()) / shards).withColumn(
        "stays", (F.sum("bytes").over(filled) <= F.col("share")) & (F.col("shard") < shards))
    stays = F.col("stays")
    moving = F.when(~stays, F.struct("bytes", (-F.col("vslot")).alias("key")))
    state = marked.agg(
        F.array(*[F.coalesce(F.sum(F.when(stays & (F.col("shard") == i), F.col("bytes"))), F.lit(0)).cast("long")
                  for i in range(shards)]).alias("loads"),
        F.sort_array(F.collect_list(moving), asc=False).alias("moving"))

    def put(state: Column, slot: Column) -> Column:
        loads = state["loads"]
        to = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        return F.struct(
            F.transform(loads, lambda x, i: F.when(i == to, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["placed"], F.array(F.struct((-slot["key"]).alias("vslot"), to.alias("to")))).alias("placed"))

    none = F.array().cast("array<struct<vslot:int,to:int>>")
    moved = state.select(F.explode(F.aggregate(
        "moving", F.struct(F.col("loads"), none.alias("placed")), put)["placed"]).alias("p")).select("p.vslot", "p.to")
    return marked.join(moved, "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"))


def balanced_map(records: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(map of the current version, sizes of its slots); both versions of the map are kept as one table."""
    sizes = stored(slot_bytes(records, slots), "slots")
    first = first_map(records.sparkSession, shards, slots)
    history = stored(first.unionByName(rebalanced(first, sizes, shards)), "slot-map")
    return history.where("version = 1").select("vslot", "shard"), sizes


def places(records: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``records`` (with ``vslot, size`` and columns to order by) with ``shard`` and place ``slot`` in it."""
    current, sizes = balanced_map(records, shards, slots)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    bases = current.join(sizes, "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("within", within).join(F.broadcast(bases), "vslot").withColumn(
        "slot", F.col("base") + F.col("within") - 1).drop("base", "within")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The narrow part of each document that sharding needs."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), record_size(docs["text"]).alias("size"),
        F.crc32("text").alias("text_crc32"), virtual_slot(docs["doc_id"], docs["text"], slots).alias("vslot"))


def with_shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All rows and columns, with the ``shard`` of each (in place of a column of that name).

    No row is shuffled.
    """
    current, _ = balanced_map(records(docs, slots), shards, slots)
    key = fresh(docs, "vslot")
    own = docs.withColumn(key, virtual_slot(docs["doc_id"], docs["text"], slots))
    return own.drop("shard").join(F.broadcast(current.withColumnRenamed("vslot", key)), key).drop(key)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(records(common.documents(spark, sf_dir)), "records")
    return places(rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot")
