"""Exact quantiles without gathering a group's values in one place."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 12


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("_n").alias("_n"))


def _narrowed(counts: DataFrame, group: list[str], part: str) -> DataFrame:
    """The parts of each group that hold a wanted rank, with the ranks as counted within them.

    ``counts``: ``group, part, _n, _targets``.  The rows of a group are at most as many as parts of it.
    """
    upto = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    here = F.transform(
        F.filter("_targets", lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_n"))),
        lambda t: F.struct(t["name"].alias("name"), t["edge"].alias("edge"), (t["rank"] - F.col("_before")).alias("rank"),
                           t["part"].alias("part")))
    return placed.select(*group, part, here.alias("_targets")).where(F.size("_targets") > 0)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    low: float = 0.0,
    high: float = 1.0,
    bins: int = BINS,
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probs``.

    The built-in ``percentile`` keeps every distinct value of a group in one task.  Here a first scan counts
    a fixed number of bins, map-side, and the running counts say which bins hold the wanted ranks.  A second
    scan divides only these into as many bins again, a third one takes only the values of the bins that are left,
    equal ones counted map-side.  So no shuffle goes by value but that of a 16-millionth of the range, and a crowded
    bin is divided and never sorted as a whole.  Values beyond ``low`` and ``high`` belong to the first and last bin.
    ``weight`` names a column that says how often a row counts.
    """
    keys = list(keys)
    n = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    position = (F.col("_v") - F.lit(low)) / F.lit(high - low) * bins

    def bin_of(x: Column) -> Column:
        # Clamped before the cast: in ANSI mode a value beyond the integers would stop the job.
        return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(bins - 1)).cast("int")

    # one key is always there, so that joins and windows are the same without any
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.lit(0).alias("_g"), F.col(value).alias("_v"), n.alias("_n")).withColumn("_b", bin_of(position))
    rows = rows.withColumn("_c", bin_of((position - F.col("_b")) * bins))
    group = [*keys, "_g"]

    def ranks(name: str, p: float) -> list[Column]:
        exact = (F.col("_total") - 1) * F.lit(float(p))
        return [F.struct(F.lit(name).alias("name"), F.lit(edge).alias("edge"), rank.cast("long").alias("rank"),
                         (exact - F.floor(exact)).alias("part"))
                for edge, rank in (("lo", F.floor(exact)), ("hi", F.ceil(exact)))]

    first = _counted(rows, [*group, "_b"]).withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    first = first.withColumn("_targets", F.array(*[r for name, p in probs.items() for r in ranks(name, p)]))
    wanted = _narrowed(first, group, "_b")
    for inner, part in (([*group, "_b"], "_c"), ([*group, "_b", "_c"], "_v")):
        # ``wanted`` has at most two rows for each quantile of a key
        known = wanted.select(*[F.col(c).alias(f"{c}_") for c in inner], "_targets")
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in inner]
        inside = rows.join(known, same).select(*inner, part, "_n", "_targets")
        counts = inside.groupBy(*inner, part).agg(F.sum("_n").alias("_n"), F.first("_targets").alias("_targets"))
        wanted = _narrowed(counts, inner, part)
    found = wanted.select(*keys, "_v", F.explode("_targets").alias("t"))

    def quantile(name: str) -> Column:
        mine = F.col("t.name") == name
        lo = F.max(F.when(mine & (F.col("t.edge") == "lo"), F.col("_v")))
        hi = F.max(F.when(mine & (F.col("t.edge") == "hi"), F.col("_v")))
        part = F.max(F.when(mine, F.col("t.part")))
        return (lo + (hi - lo) * part).alias(name)

    return found.groupBy(*keys).agg(*[quantile(name) for name in probs])
