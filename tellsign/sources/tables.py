"""Message sources over tables, and the planted test view."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellsign.fixed import PLANTED_PHRASES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages_from(df: DataFrame, msg_id: Column, user: Column, text: Column) -> DataFrame:
    return df.select(
        msg_id.alias("msg_id"), user.cast("string").alias("user"),
        text.cast("string").alias("text"),
    )


def planted_text(key: Column, text: Column) -> Column:
    """A fixed phrase, chosen by the key, in front of the whole text."""
    phrases = F.array(*[F.lit(p) for p in PLANTED_PHRASES])
    which = (key % len(PLANTED_PHRASES)).cast("int")
    return F.concat(F.get(phrases, which), F.coalesce(text, F.lit("")))


def plant(documents: DataFrame) -> DataFrame:
    return messages_from(
        documents, F.col("doc_id"), F.col("source"),
        planted_text(F.col("doc_id"), F.col("text")),
    )


def planted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as messages, with phrases that the default lexicons know."""
    return plant(table(spark, sf_dir, "documents"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages; the key joins conversation and turn."""
    turns = table(spark, sf_dir, "conversations")
    return messages_from(
        turns,
        F.concat_ws("/", F.col("conv_id"), F.col("turn")),
        F.concat(F.col("role"), F.col("conv_id")),
        F.col("text"),
    )
