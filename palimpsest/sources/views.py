"""The driver tables as the engine's own: a versioned log, file ranges, value log, manifest and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-20 00:00:00 UTC; a week of time to live for sign-ups.
NOW, WEEK = 1705708800, 604800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, version, value, meta (bit 1: tombstone), expires_at (0: never)."""
    seconds = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"),
        (F.col("event_id") + 1).alias("version"),
        F.col("props").alias("value"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("meta"),
        F.when(F.col("event_type") == "signup", seconds + WEEK).otherwise(F.lit(0)).cast("long").alias("expires_at"),
    )


def read_ts(log: DataFrame) -> int:
    """Four fifths of the version range."""
    return (log.agg(F.max("version")).first()[0] or 0) * 8 // 10


def dead(now: int = NOW):
    return ((F.col("meta").bitwiseAND(1) != 0) | ((F.col("expires_at") != 0) & (F.col("expires_at") <= now)))


def order_files(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """Files of `width` order keys: fid, min_key, max_key, n_keys, size."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.groupBy(F.expr(f"o_orderkey div {width}").alias("fid")).agg(F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"), F.count("*").alias("n_keys"), (F.count("*") * 64).alias("size"))
