"""Registration of queries, and the inputs that they share."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tellsign.plans.jobs import score_and_store, staged, stored_features
from tellsign.plans.scoring import build_features
from tellsign.sources.embeddings import stored_embeddings
from tellsign.sources.tables import planted_messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def fresh_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(planted_messages(spark, sf_dir), stored_embeddings(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored batch, written once per application and then read by every question."""
    inputs = [f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet"]
    return staged(spark, "results", inputs, lambda path: score_and_store(
        planted_messages(spark, sf_dir), path, stored_embeddings(spark, sf_dir)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(results(spark, sf_dir))
