"""How well the bands and the ranking meet given labels, per segment."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality(results: DataFrame, labels: DataFrame, segment: Sequence[str], k: int) -> DataFrame:
    """Precision at ``k`` and the rates of the confusion table of every segment.

    ``labels`` has ``msg_id`` and ``bad``; a message counts as flagged if its band is High.
    The top ``k`` are found by a rank limit that also applies before the shuffle.
    """
    keys = list(segment)
    judged = results.join(labels, "msg_id").withColumn("flagged", F.col("risk_band") == "High")
    order = Window.partitionBy(*keys).orderBy(F.desc("risk_score"), "msg_id")
    top = judged.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    at_k = top.groupBy(*keys).agg(
        F.try_divide(F.count_if("bad"), F.count(F.lit(1))).alias("precision_at_k"))
    bad, flagged = F.col("bad"), F.col("flagged")
    counts = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("judged"),
        F.count_if(bad & flagged).alias("tp"), F.count_if(~bad & flagged).alias("fp"),
        F.count_if(bad & ~flagged).alias("fn"), F.count_if(~bad & ~flagged).alias("tn"),
    )

    def rate(part: Column, whole: Column) -> Column:
        return F.try_divide(part.cast("double"), whole.cast("double"))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.join(at_k, keys).withColumns({
        "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn),
        "f1": rate(tp * 2, tp * 2 + fp + fn), "fpr": rate(fp, fp + tn),
    })
