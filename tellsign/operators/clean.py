"""Cleaning: strip, drop empty rows, remove duplicates, account for both."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellsign.fixed import NULL_TOKENS
from tellsign.functions import bitmap
from tellsign.functions import text as T
from tellsign.session import estimated_bytes, written

#: Ids that are broadcast; more are joined by key.
MOST_BROADCAST = 1_000_000


def drop_null_tokens(df: DataFrame, tokens=tuple(NULL_TOKENS)) -> DataFrame:
    """Field contents such as ``NA`` count as missing."""
    as_null = {c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in ("user", "text")}
    return df.withColumns(as_null)


def stripped(df: DataFrame) -> DataFrame:
    return df.withColumns({c: T.strip(F.col(c)) for c in ("user", "text")})


def non_empty(df: DataFrame) -> DataFrame:
    return df.filter((F.col("user") != "") & (F.col("text") != ""))


def valid_messages(df: DataFrame) -> DataFrame:
    return non_empty(stripped(df))


def message_keys(valid: DataFrame) -> DataFrame:
    """``user, digest, msg_id, text_length`` of valid messages as a written table: all that duplicates and bounds need."""
    keys = valid.select("user", F.unhex(T.fingerprint(F.col("text"))).alias("digest"), "msg_id", F.length("text").alias("text_length"))
    return written(keys, "message-keys")


def length_bounds(rows: DataFrame) -> DataFrame:
    """Shortest and longest text, one row.  Duplicates are as long as what they repeat, so they may stay in."""
    return rows.agg(F.min("text_length").alias("shortest"), F.max("text_length").alias("longest"))


def distinct_keys(keys: DataFrame) -> DataFrame:
    """One row per distinct (user, text): the smallest ``msg_id`` and the text length.

    Works on a digest, so a hot text costs one small row per map task and no text is moved.
    """
    return keys.groupBy("user", "digest").agg(
        F.min("msg_id").alias("msg_id"), F.max("text_length").alias("text_length")).select("msg_id", "text_length")


def repeated(keys: DataFrame) -> DataFrame:
    """``msg_id`` of all messages but the first of each (user, text)."""
    groups = keys.groupBy("user", "digest").agg(F.min("msg_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(groups, ["user", "digest"]).where(F.col("msg_id") != F.col("first")).select("msg_id")


def without(messages: DataFrame, removed: DataFrame) -> DataFrame:
    """Messages whose ``msg_id`` is not in the (written) table ``removed``, with the texts left where they are.

    A small table is broadcast, after its rows are counted.  Beyond that a bitmap of its ids keeps back whatever is surely
    not in it, and only the rest is moved and joined.
    """
    n = removed.count()
    if n == 0:
        return messages
    if n <= MOST_BROADCAST:
        return messages.join(F.broadcast(removed), "msg_id", "left_anti")
    maybe = bitmap.may_hold(bitmap.build(removed.select(F.xxhash64("msg_id").alias("key"))), F.xxhash64("msg_id"))
    return messages.where(~maybe).unionByName(messages.where(maybe).join(removed.hint("merge"), "msg_id", "left_anti"))


def spread(messages: DataFrame) -> DataFrame:
    """Rows dealt to all cores by ``msg_id`` if the input is smaller than a split for each of them, else as they are."""
    spark = messages.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, estimated_bytes(messages)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    small = size is not None and size < cores * spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split)
    return messages.repartition(cores, "msg_id") if small else messages


def clean_messages(df: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Strip, drop empty rows and keep the first row of each (user, text).

    Needs a unique ``msg_id``.  Duplicates are found on narrow rows (``keys``: what ``message_keys`` gave) and dropped by
    an anti join on the ids to remove; no shuffle carries a text, unless the input is too small for all cores.
    """
    valid = valid_messages(df)
    keys = message_keys(valid) if keys is None else keys
    kept = without(valid, written(repeated(keys), "repeated-ids"))
    return spread(kept).withColumn("text_length", F.length("text"))


def with_message_id(df: DataFrame) -> DataFrame:
    """Rows without a key of their own: deduplicate, then use the content hash as key.

    What comes out is clean and distinct already (``unique`` in ``build_features``).
    """
    from tellsign.functions.triage import message_id

    unique = valid_messages(df).dropDuplicates(["user", "text"])
    return unique.withColumn("msg_id", message_id(F.col("user"), F.col("text")))


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows loaded, dropped as empty, removed as duplicates and kept; one narrow shuffle."""
    rows = stripped(df)
    empty = (F.col("user") == "") | (F.col("text") == "")
    keyed = rows.select(
        empty.alias("is_empty"),
        F.when(~empty, F.col("user")).alias("user"),
        F.when(~empty, T.fingerprint(F.col("text"))).alias("digest"),
    )
    groups = keyed.groupBy("is_empty", "user", "digest").agg(F.count(F.lit(1)).alias("n"))
    count_or_0 = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(
        count_or_0(F.col("n")).alias("loaded"),
        count_or_0(F.when(F.col("is_empty"), F.col("n"))).alias("empty_dropped"),
        count_or_0(F.when(~F.col("is_empty"), F.col("n") - 1)).alias("duplicates_removed"),
        F.count_if(~F.col("is_empty")).alias("kept"),
    )


def require_rows(df: DataFrame, what: str = "dataset") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty after cleaning; valid user and text are needed")
    return df


def batch_status(batches: DataFrame, key: str) -> DataFrame:
    """``key, loaded, kept, usable`` of many batches in one table; a batch without a valid message is not usable."""
    rows = stripped(batches)
    valid = (F.col("user") != "") & (F.col("text") != "")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("loaded"), F.count_if(valid).alias("kept")).withColumn(
        "usable", F.col("kept") > 0)


def require_usable(batches: DataFrame, key: str) -> DataFrame:
    """The batches, if all of them have a valid message; else the job stops and names one that has none."""
    empty = batch_status(batches, key).where("not usable").select(key).head()
    if empty is not None:
        raise ValueError(f"batch {empty[0]} is empty after cleaning; valid user and text are needed")
    return batches
