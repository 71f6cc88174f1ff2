"""Score a message file and show the riskiest messages.

spark-submit or python -m tellsign DATASET [--weights FILE] [--top N] [--out FOLDER]
"""
from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tellsign.operators import clean, rank
from tellsign.plans.jobs import score_and_store
from tellsign.session import scratch_dir
from tellsign.sources.files import read_messages
from tellsign.sources.weights import read_weights


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tellsign")
    parser.add_argument("dataset", help="file or folder of user;text lines")
    parser.add_argument("--weights", help="JSON file with the risk weights")
    parser.add_argument("--top", type=int, default=20)
    parser.add_argument("--out", help="folder for the result table")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tellsign").getOrCreate()
    weights = read_weights(spark, args.weights) if args.weights else None
    raw = clean.with_message_id(read_messages(spark, args.dataset))
    results = score_and_store(raw, args.out or scratch_dir(spark, "run"), weights=weights, unique=True)
    top = rank.console_report(clean.require_rows(results), args.top)
    top.show(max(1, args.top), truncate=False)


if __name__ == "__main__":
    main()
