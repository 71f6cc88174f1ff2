"""Embedding sources: a stored vector table or an encoder run once per distinct text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellsign.fixed import ENCODER_BATCH
from tellsign.functions.signals import semantic_signal, unit_vector
from tellsign.functions.text import fingerprint
from tellsign.operators.clean import MOST_BROADCAST, without
from tellsign.session import written


def stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").alias("msg_id"), "embedding")


def signals(embeddings: DataFrame) -> DataFrame:
    """(msg_id, semantic_signal) of a vector table.

    The signal needs nothing but the vector, so it is taken before any join: one number per
    message is moved and not a vector.  Vectors are scaled to length one first; one that holds
    NaN or infinity stops the job, a zero vector counts as none.  ``msg_id`` must be unique.
    """
    return embeddings.select("msg_id", semantic_signal(unit_vector(F.col("embedding"))).alias("semantic_signal"))


def attach(messages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Left join of the semantic signal by message key; no vector means 0.

    Only signals are joined, never vectors.  Those of few messages are broadcast, after a count, and the texts stay where
    they are; beyond that both sides are sorted and merged by key, which spills.
    """
    narrow = signals(embeddings)
    narrow = F.broadcast(narrow) if embeddings.count() <= MOST_BROADCAST else narrow.hint("merge")
    joined = messages.join(narrow, "msg_id", "left")
    return joined.withColumn("semantic_signal", F.coalesce("semantic_signal", F.lit(0.0)))


def encode_distinct(
    messages: DataFrame,
    make_predict: Callable,
    batch_size: int = ENCODER_BATCH,
) -> DataFrame:
    """Run an encoder once per distinct text and give every message its unit vector.

    ``make_predict`` loads the model inside a task and returns a function from a batch of
    texts to a 2-d array.  The result has ``msg_id`` and ``embedding``.
    """
    from pyspark.ml.functions import predict_batch_udf

    encode = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    keyed = written(messages.select("msg_id", F.unhex(fingerprint(F.col("text"))).alias("digest")), "text-digests")
    firsts = keyed.groupBy("digest").agg(F.min("msg_id").alias("msg_id"))
    # the texts are encoded where they are; those of all but the first message of each text are dropped by key
    again = written(keyed.join(firsts.withColumnRenamed("msg_id", "first"), "digest").where(
        F.col("msg_id") != F.col("first")).select("msg_id"), "repeated-texts")
    vectors = without(messages.select("msg_id", "text"), again).select("msg_id", encode("text").alias("raw")).select(
        "msg_id", unit_vector(F.col("raw")).alias("embedding"))
    return keyed.join(firsts.join(vectors, "msg_id").drop("msg_id"), "digest").select("msg_id", "embedding")
