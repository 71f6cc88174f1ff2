"""Risk weights: reading, checking and reporting."""
from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.fixed import DEFAULT_WEIGHTS
from tellsign.functions.scoring import label_of

MAX_WEIGHTS = 1_000


def read_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """Read a JSON object of weights in file order.

    The order decides ties between drivers, which is why the object is read as a map:
    a struct schema would be sorted by name.
    """
    entries = (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", "map<string,double>").alias("w"))
        .select(F.posexplode(F.map_entries("w")).alias("ord", "e"))
        .select("ord", "e.key", "e.value")
        .orderBy("ord")
        .limit(MAX_WEIGHTS + 1)
        .collect()
    )
    if len(entries) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights in {path}")
    loaded = {row["key"]: row["value"] for row in entries}
    missing = [name for name in DEFAULT_WEIGHTS if name not in loaded]
    if missing:
        raise ValueError(f"weights without a value for: {missing}")
    _check_values(loaded)
    return loaded


def _check_values(weights: Mapping[str, float | None]) -> None:
    bad = [k for k, v in weights.items() if v is None or not math.isfinite(v) or v < 0]
    if bad:
        raise ValueError(f"weights must be finite and not negative: {bad}")


def validate_update(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights of a rescoring: a subset of the known names with a positive sum."""
    if not weights:
        raise ValueError("no weights given")
    unknown = [name for name in weights if name not in DEFAULT_WEIGHTS]
    if unknown:
        raise ValueError(f"unknown weights: {unknown}")
    _check_values(weights)
    if sum(weights.values()) <= 0:
        raise ValueError("the sum of the weights must be positive")
    return {name: float(value) for name, value in weights.items()}


def weight_frame(spark: SparkSession, weights: Mapping[str, float] | None = None) -> DataFrame:
    weights = DEFAULT_WEIGHTS if weights is None else weights
    rows = [(i, name, label_of(name), float(v)) for i, (name, v) in enumerate(weights.items())]
    return spark.createDataFrame(rows, "ord int, feature string, label string, weight double")


def weight_report(spark: SparkSession, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Current weights with a flag that tells them from the defaults."""
    custom = bool(weights) and dict(weights) != DEFAULT_WEIGHTS
    return weight_frame(spark, weights or None).withColumn("is_custom", F.lit(custom))
