"""Tables that outlive a run: queue snapshots and append-only logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tellsign.operators.history import tail_of_log


def _folder(spark: SparkSession, path: str):
    """The file system and path of a folder."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def names(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the folders ``<key>=<value>`` below ``path``, in order."""
    fs, folder = _folder(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.split("=", 1)[1] for n in found if n.startswith(f"{key}="))


def numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    return sorted(int(n) for n in names(spark, path, key))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    fs, marker = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def snapshot_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose write was finished, oldest first."""
    return [v for v in numbers(spark, root, "version") if finished(spark, f"{root}/version={v}")]


def expire_snapshots(spark: SparkSession, root: str, keep: int = 5) -> list[int]:
    """Remove all but the newest ``keep`` finished versions, and what older failed writes left; gives those that stay."""
    kept = snapshot_versions(spark, root)[-max(keep, 1):]
    for version in numbers(spark, root, "version"):
        if kept and version < kept[0]:
            remove(spark, f"{root}/version={version}")
    return kept


def next_version(spark: SparkSession, root: str) -> int:
    return max(numbers(spark, root, "version"), default=0) + 1


def write_snapshot(df: DataFrame, root: str, version: int | None = None) -> int:
    """Write the next version.  Older ones stay as they are, so readers are not disturbed
    and a failed write leaves the last version valid.  If two writers take the same version, the
    later one fails instead of replacing what the other wrote."""
    version = next_version(df.sparkSession, root) if version is None else version
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    return version


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    versions = snapshot_versions(spark, root)
    if not versions:
        return None
    return spark.read.parquet(f"{root}/version={version or versions[-1]}")


def append_log(entries: DataFrame, path: str, key: str | None = None) -> None:
    """Append entries.  With a ``key``, those whose key is logged already are left out, so a
    repeated run adds nothing."""
    spark = entries.sparkSession
    fs, folder = _folder(spark, path)
    if key is not None and fs.exists(folder):
        known = spark.read.schema(entries.schema).parquet(path).select(key)
        entries = entries.join(known, key, "left_anti").select(*entries.columns)
    entries.write.mode("append").parquet(path)


def load_log(spark: SparkSession, path: str, key: str, n: int) -> DataFrame:
    return tail_of_log(spark.read.parquet(path), key, n)


def trim_log(spark: SparkSession, path: str, new_path: str, key: str, n: int) -> DataFrame:
    """Write the newest ``n`` entries to a new place; the old log is left alone."""
    load_log(spark, path, key, n).write.mode("errorifexists").parquet(new_path)
    return spark.read.parquet(new_path)
