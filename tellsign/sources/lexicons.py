"""Phrase lists as tables: ``ord, family, kind ('keyword' or 'regex'), phrase``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.fixed import KEYWORDS, PATTERNS

SCHEMA = "ord long, family string, kind string, phrase string"


def fixed_phrases(spark: SparkSession) -> DataFrame:
    """The built-in word lists as a table."""
    rows = [(f, k, p) for k, table in (("regex", PATTERNS), ("keyword", KEYWORDS)) for f, ps in table.items() for p in ps]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)


def read_phrases(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """A stored table; CSV and JSON files need the four columns by name."""
    reader = spark.read.format(format).options(**options)
    rows = reader.load(path) if format == "parquet" else reader.schema(SCHEMA).load(path)
    missing = {c.split()[0] for c in SCHEMA.split(", ")} - set(rows.columns)
    if missing:
        raise ValueError(f"phrase table lacks {', '.join(sorted(missing))}")
    return rows.select(F.col("ord").cast("long").alias("ord"), "family", "kind", "phrase")
