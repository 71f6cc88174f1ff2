"""Session settings and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_KEY = "spark.sql.shuffle.partitions"
#: Removes the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
TIDY_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BYTES_PER_PARTITION = 256 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tellsign")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_local_root: list[str] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the one all executors can reach.

    Only a local session without that setting gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="tellsign-"))
        root = _local_root[0]
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder; what is built on it does not run it again, so its shuffle files go."""
    spark = df.sparkSession
    path, before = scratch_dir(spark, purpose), spark.conf.get(TIDY_KEY, "false")
    spark.conf.set(TIDY_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(input_bytes: int, at_least: int) -> int:
    """Shuffle partitions for an input of a size; adaptive execution joins small ones."""
    return max(at_least, -(-input_bytes // BYTES_PER_PARTITION))


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's own estimate of an input's size; None if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


@contextmanager
def sized_shuffles(df: DataFrame) -> Iterator[int]:
    """Raise the number of shuffle partitions for a job over ``df``, and put it back.

    Adaptive execution can join partitions but never make more of them, so the session's
    default would be the limit for a large input.
    """
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_KEY)
    size = estimated_bytes(df)
    wanted = int(before) if size is None else partitions_for(size, int(before))
    spark.conf.set(SHUFFLE_KEY, str(wanted))
    try:
        yield wanted
    finally:
        spark.conf.set(SHUFFLE_KEY, before)
