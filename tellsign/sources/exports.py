"""CSV exports with a small metadata table beside them."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.functions.triage import as_time
from tellsign.operators.filters import ResultFilter
from tellsign.operators.kpi import user_summary

STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("errorifexists").option("header", True).option("escape", '"')
        .option("quote", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').csv(path)
    )


def export_results(
    results: DataFrame, path: str, now: dt.datetime | Column, weights_name: str
) -> None:
    """All results to ``path/data``; time, number of records and weights to ``path/meta``."""
    _write_csv(results, f"{path}/data")
    meta = results.agg(F.count(F.lit(1)).alias("records")).select(
        F.lit("Export").alias("title"), F.date_format(as_time(now), STAMP).alias("generated"),
        "records", F.lit(weights_name).alias("weights"))
    meta.write.mode("errorifexists").json(f"{path}/meta")


def export_users(results: DataFrame, path: str) -> None:
    _write_csv(user_summary(results), path)


def export_filtered(
    results: DataFrame, spec: ResultFilter, path: str, now: dt.datetime | Column
) -> None:
    """Filtered results; the metadata tells how many of how many, and the bounds."""
    _write_csv(spec.apply(results), f"{path}/data")
    total = results.agg(F.count(F.lit(1))).scalar()
    meta = spec.apply(results).agg(F.count(F.lit(1)).alias("records")).select(
        F.lit("Filtered Export").alias("title"),
        F.date_format(as_time(now), STAMP).alias("generated"), "records", total.alias("total"),
        F.lit(spec.min_risk).alias("min_risk"), F.lit(spec.max_risk).alias("max_risk"))
    meta.write.mode("errorifexists").json(f"{path}/meta")
