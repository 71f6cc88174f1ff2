"""From raw documents to training shards: each stage works on what the one before kept.

All stages but the last keep the columns of their input, whatever they are named.  Null and empty texts and rows
without id pass: quality scores an empty text like any other, near duplicates and benchmark items need words.  ``mix`` gives no rows
for documents without words, and a document up to three times, so ids may repeat after it.  An empty table gives empty results.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tellsign.llm import common, decontaminate, minhash, mixing, quality, shards


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows of one id and text share their fate."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; documents without words are no one's duplicate."""
    return minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; items without words are in none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: each document as often as its first block is taken."""
    return mixing.mixed_documents(docs, minhash.node_id(docs["doc_id"], docs["text"]))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its ``shard``, by virtual slots, with near equal bytes."""
    return shards.with_shard(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
    ("shard", shard),
]

#: The quality classifier is learned, so no SQL gives the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
