"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellsign.llm.common import stored

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
        F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(pairs: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``pairs`` (two long columns ``u, v``).

    The component is its smallest node.  Each round is two stars over the edge list and is
    written, so the plan stays short and no list of neighbours is gathered: the only state of
    a node is its least neighbour, a map-side aggregate.  Ends when a round changes nothing;
    the number of rounds grows with the logarithm of the longest path.  Loops and repeated
    pairs do no harm, an empty table gives an empty table, pairs with a null are left out.
    """
    edges = stored(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        edges = stored(_small_star(_large_star(edges)), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
