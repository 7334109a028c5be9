"""Streams of versions (extension): newest version of each key, and log tailing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.batch import decode
from palimpsest.sources.record_log import register


def newest(versions: DataFrame) -> DataFrame:
    """Newest version of each key, tombstones included; a stream updates it, a batch computes it.

    State holds one version for each key whatever the stream's length.
    """
    entry = F.struct("seq", "type", "value")
    best = versions.groupBy("user_key").agg(F.max_by(entry, F.struct("seq", "type")).alias("v"))
    return best.select("user_key", F.col("v.seq").alias("seq"), F.col("v.type").alias("type"), F.col("v.value").alias("value"))


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Version rows of batches appended to the logs under ``path``, as a stream."""
    register(spark)
    records = spark.readStream.format("record_log").load(path)
    ops = decode(records.withColumnRenamed("payload", "contents"), [])
    return ops.select("user_key", (F.col("base") + F.col("op_index")).alias("seq"), "type", "value")
