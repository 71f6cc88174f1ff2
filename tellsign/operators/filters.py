"""Result filters: validated parameters that become plain predicates."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellsign.functions.text import contains_ignore_case


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class ResultFilter:
    """Bounds are inclusive; an empty list or a blank text means no restriction."""

    min_risk: float = 0.0
    max_risk: float = 1.0
    bands: Sequence[str] | None = None
    drivers: Sequence[str] | None = None
    users: Sequence[str] | None = None
    text_query: str = ""
    top_n: int = 25
    offset: int = 0
    limit: int = 100

    def __post_init__(self) -> None:
        _check(0.0 <= self.min_risk <= 1.0, "min_risk must be within [0, 1]")
        _check(0.0 <= self.max_risk <= 1.0, "max_risk must be within [0, 1]")
        _check(len(self.text_query) <= 512, "text_query is longer than 512 characters")
        _check(1 <= self.top_n <= 1000, "top_n must be within 1..1000")
        _check(self.offset >= 0, "offset must not be negative")
        _check(1 <= self.limit <= 500, "limit must be within 1..500")

    def predicate(self) -> Column:
        """All restrictions as one condition, ready for pushdown."""
        cond = F.col("risk_score").between(self.min_risk, self.max_risk)
        if self.bands:
            cond = cond & F.col("risk_band").isin(*self.bands)
        if self.drivers:
            cond = cond & F.col("top_risk_driver").isin(*self.drivers)
        if self.users:
            cond = cond & F.col("user").isin(*self.users)
        if self.text_query.strip():
            cond = cond & contains_ignore_case(F.col("text"), self.text_query)
        return cond

    def apply(self, results: DataFrame) -> DataFrame:
        return results.filter(self.predicate())


def of_user(results: DataFrame, user: str) -> DataFrame:
    return results.filter(F.col("user") == user)
