"""Large values apart from their keys: layout of the value log, dereference, garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes from which a value leaves the index; of a record beside key and value; of a file, counted by where records begin.
THRESHOLD, OVERHEAD, FILE_BYTES, CELL = 1024, 21, 1 << 20, 500
#: Cells of a group of the layout's running sum.
GROUP = 100_000


def placed(docs: DataFrame) -> DataFrame:
    """key, fid, offset, len of the rows at or above THRESHOLD, in order of key.

    A prefix sum in three levels: within cells of CELL keys, over the cells of a group of GROUP cells, and over the groups. With GROUP
    as large as it is, a task sees a cell's rows, a group's cells, or all groups: 10^11 keys make 2000 of the last. Only keys and
    lengths are moved."""
    rows = docs.select(F.col("doc_id").alias("key"), (F.octet_length("text") + F.length(F.col("doc_id").cast("string")) + OVERHEAD).cast("long").alias("len"), F.octet_length("text").alias("_v")).where(F.col("_v") >= THRESHOLD).drop("_v")
    rows = rows.withColumn("_cell", F.expr(f"key div {CELL}"))
    cells = rows.groupBy("_cell").agg(F.sum("len").alias("_n")).withColumn("_group", F.expr(f"_cell div {GROUP}"))
    groups = cells.groupBy("_group").agg(F.sum("_n").alias("_g"))
    groups = groups.select("_group", (F.sum("_g").over(Window.orderBy("_group")) - F.col("_g")).alias("_first"))
    cells = cells.withColumn("_in", F.sum("_n").over(Window.partitionBy("_group").orderBy("_cell")) - F.col("_n")).join(groups, "_group")
    at = F.col("_first") + F.col("_in") + F.sum("len").over(Window.partitionBy("_cell").orderBy("key")) - F.col("len")
    found = rows.join(cells.select("_cell", "_first", "_in"), "_cell").withColumn("_at", at).withColumn("fid", F.expr(f"_at div {FILE_BYTES}"))
    return found.select("key", "fid", (F.col("_at") % FILE_BYTES).alias("offset"), "len")


def layout(docs: DataFrame) -> DataFrame:
    """placed() with the values."""
    return placed(docs).join(docs.select(F.col("doc_id").alias("key"), F.col("text").alias("value")), "key")


def rewritten(log: DataFrame, picked: DataFrame, live: DataFrame) -> DataFrame:
    """key, fid, offset, len, old_fid, old_offset: the live records of the picked file, appended to a new one in their order. They are
    those of one file, so a single running sum is enough."""
    top = log.agg((F.max("fid") + 1).alias("_top"))
    kept = log.join(F.broadcast(picked.select("fid")), "fid", "left_semi").join(live.select("key"), "key", "left_semi")
    at = F.sum("len").over(Window.orderBy("offset")) - F.col("len")
    return kept.withColumn("_at", at).join(F.broadcast(top)).select("key", F.col("_top").alias("fid"), F.col("_at").alias("offset"), "len", F.col("fid").alias("old_fid"), F.col("offset").alias("old_offset"))


def index(docs: DataFrame, log: DataFrame) -> DataFrame:
    """key, inline (the value of a small row), fid and offset (of a large one)."""
    small = docs.select(F.col("doc_id").alias("key"), F.when(F.octet_length("text") < THRESHOLD, F.col("text")).alias("inline"))
    return small.join(log.select("key", "fid", "offset"), "key", "left")


def deref(idx: DataFrame, log: DataFrame) -> DataFrame:
    held = log.select("fid", "offset", F.col("value").alias("_v"))
    return idx.join(held, ["fid", "offset"], "left").select("key", F.coalesce("inline", "_v").alias("value"))


def garbage(log: DataFrame, live: DataFrame) -> DataFrame:
    return log.join(live.select("key"), "key", "left_anti")


def discard_ratio(log: DataFrame, live: DataFrame) -> DataFrame:
    marked = log.select("key", "fid", "len").join(live.select("key", F.lit(True).alias("_live")), "key", "left")
    lost = F.sum(F.when(F.col("_live").isNull(), F.col("len")).otherwise(0))
    return marked.groupBy("fid").agg(F.sum("len").cast("long").alias("size"), lost.cast("long").alias("discard"))
