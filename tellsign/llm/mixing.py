"""Mixing sources to target weights by blocks of tokens.

* The words of a source are packed into blocks of ``block`` words: its documents stand on a line, in an
  order fixed by their ids, and block ``i`` is the ``i``-th piece of the line.
* The mix is a sequence of slots of one block each, dealt to output shards of ``shard_slots`` slots.  In each
  shard every slot draws its source by a hash, so the counts of a shard are a multinomial
  draw with the target shares.  Over the whole mix the draws of a source may miss its target a little;
  slots drawn beyond it are handed, in order, to the sources that were drawn too rarely.
* The ``j``-th slot of a source takes block ``p(j mod n)`` of its ``n`` blocks, ``p`` being a pseudorandom
  permutation of the indices (swap-or-not rounds over hashes) made anew for each pass.  So each block is taken
  ``j / n`` times, rounded down or up, and at most ``repeats`` times.
* Slots and blocks are joined by source and index, blocks and documents by their places on the line.

All of it is expressions and equi-joins over narrow rows.  A line is summed up in two steps (within chunks
of a source, then over the chunks), so a hot source is many tasks.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating.  They share all words by
weight; a target stops at ``repeats`` times the words of its source and the excess is shared again by weight.

Nulls and ties: a null text has no words and is taken 0 times; a null source is a source; repeated rows
stand on the line one after another.  An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellsign.llm import common
from tellsign.llm.common import WORD_PATTERN, fresh, stored

REPEATS = 3
SHARD_SLOTS = 4096
CHUNK_ROWS = 50_000
PERMUTE_ROUNDS = 16
LEAST_CELLS = 1024
#: Words of a block, whatever the size of the input; a source misses its target by about half a block.
BLOCK = 64
SEED = 20240611


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(rows: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``source, sid, source_size, target`` of each source of ``rows`` (``source, size``).

    The excess of stopped targets flows to the others until none is above.  In ascending order of
    limit / weight the stopped ones come first, and the level at which the others stand follows from sums
    over those before.  One row for each source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.pmod(F.col("sid") - 1, F.lit(3)) + 1
    weighed = named.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum(
        "weight").over(after)
    # the first source that does not stop gives the level of all later ones
    leveled = weighed.withColumn("free", F.when(level <= F.col("most") / F.col("weight"), level)).withColumn(
        "level", F.first("free", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return leveled.select("source", "sid", "source_size", F.coalesce(
        F.col("level") * F.col("weight"), F.col("most")).cast("double").alias("target"))


def lines(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``sid, key, size``) with ``start``, the words before it on the line of its source."""
    chunk = F.pmod(F.xxhash64("key", "size"), F.lit(max(1, -(-n // CHUNK_ROWS))))
    own = rows.withColumn("chunk", chunk)
    bases = own.groupBy("sid", "chunk").agg(F.sum("size").alias("words")).withColumn(
        "base", F.coalesce(F.sum("words").over(
            Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("sid", "chunk").orderBy("key", "size")
    placed = own.withColumn("row", F.row_number().over(order)).withColumn(
        "within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(bases.select("sid", "chunk", "base"), ["sid", "chunk"]).withColumn(
        "start", F.col("base") + F.col("within")).drop("base", "within")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 at ``index``: swap-or-not rounds keyed by ``key``."""
    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) + n - x, n)
        coin = F.xxhash64(F.lit(SEED + 1), r, F.greatest(x, partner), *key)
        return F.when(coin % 2 == 0, x).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(PERMUTE_ROUNDS)), index.cast("long"), swap)


def draws(sources: DataFrame, slots: int, n_sources: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, slot, sid`` for each slot of the mix, drawn by the quotas of ``sources`` (``sid, quota``).

    A slot draws a point on the line of all quotas.  Points and sources meet in cells of that line.
    """
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    ranged = sources.where("quota > 0").withColumn(
        "lo", F.coalesce(F.sum("quota").over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col("quota"))
    cells = max(LEAST_CELLS, 2 * n_sources)

    def cell(x: Column) -> Column:
        return F.floor(x * cells / max(slots, 1))

    by_cell = ranged.select("sid", "lo", "hi", F.explode(
        F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    rows = sources.sparkSession.range(slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod("id", F.lit(shard_slots)).alias("slot"))
    drawn = rows.withColumn("point", F.pmod(F.xxhash64(F.lit(SEED), "shard", "slot"), F.lit(max(slots, 1))))
    return drawn.withColumn("cell", cell(F.col("point"))).join(by_cell, "cell").where(
        "point >= lo and point < hi").select("shard", "slot", "sid")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``j``, the number of the slot among those of its source, counted over the shards."""
    base = rows.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(
            Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = rows.withColumn("j", F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1)
    return own.join(base.select("sid", "shard", "base"), ["sid", "shard"]).withColumn(
        "j", F.col("j") + F.col("base")).drop("base")


def settled(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """``drawn`` with every source at its quota: later draws beyond it fill what others lack, in order."""
    counts = drawn.groupBy("sid").agg(F.max("j").alias("last"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    state = sources.join(counts, "sid", "left").select("sid", "quota", (F.coalesce("last", F.lit(-1)) + 1).alias("n"))
    state = state.withColumn("over", F.greatest(F.col("n") - F.col("quota"), F.lit(0))).withColumn(
        "lacks", F.greatest(F.col("quota") - F.col("n"), F.lit(0))).withColumn(
        "over_base", F.coalesce(F.sum("over").over(before), F.lit(0))).withColumn(
        "lack_base", F.coalesce(F.sum("lacks").over(before), F.lit(0)))
    ranked = drawn.join(state.select("sid", "quota", "over_base"), "sid")
    over = ranked.where("j >= quota").select(
        "shard", "slot", (F.col("over_base") + F.col("j") - F.col("quota")).alias("rank"))
    gaps = state.where("lacks > 0").select("sid", "n", "lack_base", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("lacks") - 1)).alias("i")).select(
        "sid", (F.col("n") + F.col("i")).alias("j"), (F.col("lack_base") + F.col("i")).alias("rank"))
    return ranked.where("j < quota").select("shard", "slot", "sid", "j").unionByName(
        over.join(gaps, "rank").select("shard", "slot", "sid", "j"))


class Mix:
    """Tables of one mix: ``sources``, ``line`` (documents on the lines of their sources) and ``slots``."""

    def __init__(self, rows: DataFrame, repeats: int = REPEATS, shard_slots: int = SHARD_SLOTS, block: int = BLOCK):
        """``rows``: ``key, source, size``."""
        rows = stored(rows.select("key", "source", F.col("size").cast("long").alias("size")), "sizes")
        sources = stored(targets(rows, repeats), "sources")
        n = rows.count()
        n_sources = sources.count()
        self.block = block
        blocks = F.ceil(F.col("source_size") / self.block)
        quota = F.when(F.col("source_size") > 0, F.least(
            F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), blocks * repeats)).otherwise(0)
        self.sources = sources.withColumn("blocks", blocks).withColumn("quota", quota)
        named = rows.join(sources.select(F.col("source").alias("name"), "sid"), F.col("source").eqNullSafe(F.col("name")))
        self.line = stored(lines(named.select("sid", "key", "size"), n), "lines")
        slots = self.sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
        drawn = numbered(draws(self.sources, slots, n_sources, shard_slots))
        index = F.col("j") % F.col("blocks")
        turn = F.floor(F.col("j") / F.col("blocks"))
        self.slots = stored(settled(drawn, self.sources).join(self.sources.select("sid", "blocks"), "sid").select(
            "shard", "slot", "sid", permuted(index, F.col("blocks"), F.col("sid"), turn).alias("block")), "mix-slots")

    def uses(self) -> DataFrame:
        """How often each block is taken; blocks that are not taken have no row."""
        return self.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))

    def pieces(self) -> DataFrame:
        """The documents cut at the ends of blocks: ``words`` of each document in each block."""
        first, last = F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block)
        cut = self.line.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
        lo, hi = F.col("block") * self.block, (F.col("block") + 1) * self.block
        return cut.withColumn("words", F.least(F.col("start") + F.col("size"), hi) - F.greatest("start", lo))

    def taken(self) -> DataFrame:
        """``key, size, source_size, target, taken`` of every document row."""
        used = self.pieces().join(self.uses(), ["sid", "block"]).groupBy("sid", "chunk", "row").agg(
            F.sum(F.col("words") * F.col("uses")).alias("taken"))
        return self.line.join(used, ["sid", "chunk", "row"], "left").join(
            self.sources.select("sid", "source_size", "target"), "sid").select(
            "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def copies(self) -> DataFrame:
        """``key, copies``: how often the block with the first word of a document is taken."""
        first = self.line.where("size > 0").withColumn("block", F.floor(F.col("start") / self.block))
        return first.join(self.uses(), ["sid", "block"]).groupBy("key").agg(F.max("uses").alias("copies"))


def mixed_documents(docs: DataFrame, key: Column, repeats: int = REPEATS) -> DataFrame:
    """The documents of the mix, with all columns, each as often as its first block is taken.

    ``key`` names a document; rows of one key are taken equally often.
    """
    own = docs.withColumn(name := fresh(docs, "key"), key)
    mix = Mix(own.select(F.col(name).alias("key"), docs["source"], word_count(docs["text"]).alias("size")), repeats)
    many = fresh(own, "copies")
    copies = mix.copies().toDF(name, many)
    return own.join(copies.hint("merge"), name).withColumn(
        many, F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    mix = Mix(docs.select(F.col("doc_id").cast("long").alias("key"), "source", word_count(F.col("text")).alias("size")))
    return mix.taken().withColumnRenamed("key", "doc_id")
