"""Replay of the manifest and of the write-ahead log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live_files(changes: DataFrame) -> DataFrame:
    """fid, seq of files whose last change (fid, seq, op) is their creation."""
    return changes.groupBy("fid").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")).where("op = 'CREATE'").select("fid", "seq")


def compacted(changes: DataFrame) -> DataFrame:
    """The shortest manifest with the same files: their creations."""
    return live_files(changes).select("fid", F.lit("CREATE").alias("op"), "seq")


def rewrite_due(changes: DataFrame, least: int, ratio: int) -> DataFrame:
    """created, deleted, due: whether deletions are many, and many times the files that are left."""
    n = changes.agg(F.count(F.when(F.col("op") == "CREATE", 1)).alias("created"), F.count(F.when(F.col("op") == "DELETE", 1)).alias("deleted"))
    return n.withColumn("due", (F.col("deleted") > least) & (F.col("deleted") > ratio * (F.col("created") - F.col("deleted"))))


def violations(changes: DataFrame) -> DataFrame:
    """Creations of a file that exists and deletions of one that doesn't."""
    before = F.lag("op").over(Window.partitionBy("fid").orderBy("seq"))
    return changes.withColumn("_b", F.coalesce(before, F.lit("DELETE"))).where("_b = op").select("fid", "seq", "op")


def differences(live: DataFrame, found: DataFrame) -> DataFrame:
    """Files missing from the directory (fid) and files there that the manifest doesn't know."""
    return live.select("fid").join(found, "fid", "left_anti").select("fid", F.lit("missing").alias("kind")).union(found.select("fid").join(live, "fid", "left_anti").select("fid", F.lit("orphan").alias("kind")))


def replay(wal: DataFrame) -> DataFrame:
    """Rows of wal (pos, ts, kind: plain, txn or fin) that take effect: plain ones, and txn ones whose ts has its end marker."""
    ends = wal.where("kind = 'fin'").select("ts").distinct()
    return wal.where("kind = 'plain'").select("pos", "ts").union(wal.where("kind = 'txn'").join(ends, "ts", "left_semi").select("pos", "ts"))


def valid_prefix(wal: DataFrame) -> DataFrame:
    """Rows before the first bad one."""
    first = wal.where("not crc_ok").agg(F.min("pos").alias("_bad"))
    return wal.join(F.broadcast(first), F.col("_bad").isNull() | (F.col("pos") < F.col("_bad"))).select("pos")
