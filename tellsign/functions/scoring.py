"""From signals to an explained score."""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellsign.fixed import (
    BANDS, BAND_COLORS, COUNT_FEATURES, DEFAULT_WEIGHTS, FEATURE_LABELS, UNKNOWN_BAND_COLOR,
)


def unit_value(value: Column, feature: str) -> Column:
    """Map a signal to [0, 1]: counts saturate, everything else is clipped."""
    floor0 = F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    if feature in COUNT_FEATURES:
        return F.lit(1.0) - F.exp(-floor0)
    return F.least(floor0, F.lit(1.0))


def with_missing_features(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    missing = {f: F.lit(0.0) for f in weights if f not in df.columns}
    return df.withColumns(missing) if missing else df


def score(
    df: DataFrame, weights: Mapping[str, float] | None = None, explain: bool = True
) -> DataFrame:
    """Add one contribution per weight, the raw and the normalised score and the driver.

    All of it is row-local; the weights are literals in the plan.
    """
    weights = dict(DEFAULT_WEIGHTS if weights is None else weights)
    df = with_missing_features(df, weights)
    df = df.withColumns(
        {f"contrib_{f}": unit_value(F.col(f), f) * F.lit(float(w)) for f, w in weights.items()}
    )
    parts = [F.col(f"contrib_{f}") for f in weights]
    df = df.withColumn("risk_raw", reduce(lambda a, b: a + b, parts, F.lit(0.0)))
    total = float(sum(weights.values()))
    if total > 0:
        share = F.least(F.greatest(F.col("risk_raw") / F.lit(total), F.lit(0.0)), F.lit(1.0))
    else:
        share = F.lit(0.0)
    df = df.withColumn("risk_score", share)
    return df.withColumn("top_risk_driver", top_driver(weights)) if explain else df


def top_driver(weights: Mapping[str, float]) -> Column:
    """The feature with the largest contribution; the first in weight order wins a tie."""
    names = list(weights)
    best = F.greatest(*[F.col(f"contrib_{f}") for f in names]) if len(names) > 1 else F.col(
        f"contrib_{names[0]}")
    chain = F
    for f in names:
        chain = chain.when(F.col(f"contrib_{f}") == best, F.lit(f))
    return chain


def risk_band(value: Column) -> Column:
    chain = F
    for name, low, high in BANDS:
        chain = chain.when((value >= low) & (value < high), F.lit(name))
    return chain


def band_color(band: Column) -> Column:
    chain = F
    for name, color in BAND_COLORS.items():
        chain = chain.when(band == name, F.lit(color))
    return chain.otherwise(F.lit(UNKNOWN_BAND_COLOR))


def feature_label(feature: Column) -> Column:
    """Display name of a feature; unknown names pass through."""
    pairs = [F.lit(x) for item in FEATURE_LABELS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), feature), feature)


def label_of(feature: str) -> str:
    return FEATURE_LABELS.get(feature, feature)


def with_risk_band(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_band", risk_band(F.col("risk_score")))
