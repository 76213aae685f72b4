"""What is compacted next: targets and scores of levels, tables picked, and where output files are cut.

Files are rows of metadata (level, fid, min_key, max_key, max_version, size); levels are few, whatever the data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retention import run_stats


@dataclass(frozen=True)
class Options:
    levels: int = 7
    level_zero_tables: int = 3
    base_level: int = 20_000
    level_multiplier: int = 10
    table: int = 2_000
    table_multiplier: int = 2
    memtable: int = 4_000


def level_files(log: DataFrame, per_run: int = 100, per_level: int = 3, levels: int = 7) -> DataFrame:
    """Runs of the log as files: older ones lie deeper."""
    runs = run_stats(log, per_run)
    newest = runs.agg(F.max("fid").alias("_top"))
    level = F.least(F.floor((F.col("_top") - F.col("fid")) / per_level), F.lit(levels - 1)).cast("int")
    return runs.join(F.broadcast(newest)).select(level.alias("level"), "fid", "min_key", "max_key", "max_version", "key_count", "size")


def level_targets(spark: SparkSession, sizes: dict[int, int], o: Options = Options()) -> DataFrame:
    """level, target, file_size, is_base. sizes: bytes by level; levels that are missing are empty.

    The last level's size over powers of the multiplier, at least base_level. The base level is the deepest whose target is no more than
    base_level, moved down over empty levels, and once more if it is empty itself and the next one is smaller than a file of it."""
    total = [sizes.get(i, 0) for i in range(o.levels)]
    last = o.levels - 1
    targets = [0, *[max(o.base_level, total[last] // o.level_multiplier ** (last - i)) for i in range(1, o.levels)]]
    base = max((i for i in range(1, o.levels) if targets[i] <= o.base_level), default=0)
    files = [o.memtable, *[o.table * o.table_multiplier ** max(0, i - base) for i in range(1, o.levels)]]
    base = next((i - 1 for i in range(base + 1, last) if total[i]), max(base, last - 1))
    if base < last and not total[base] and total[base + 1] < files[base + 1]:
        base += 1
    return spark.createDataFrame([(i, targets[i], files[i], i == base) for i in range(o.levels)], "level int, target long, file_size long, is_base boolean")


def compaction_scores(files: DataFrame, targets: DataFrame, o: Options = Options()) -> DataFrame:
    """level, score, adjusted of levels with a score of 1 or more. Scores are true quotients: tables over those allowed in level 0,
    bytes over target below. Level 0 and the levels from the base down form a chain; a score above 1 is divided by the next one's."""
    held = files.groupBy("level").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    base = targets.where("is_base").select(F.col("level").alias("_base"))
    each = targets.join(held, "level", "left").join(F.broadcast(base))
    score = F.when(F.col("level") == 0, F.coalesce("_n", F.lit(0)) / o.level_zero_tables).otherwise(F.coalesce("_size", F.lit(0)) / F.col("target"))
    each = each.select("level", score.alias("score"), ((F.col("level") == 0) | (F.col("level") >= F.col("_base"))).alias("_chain"))
    following = F.lead("score").over(Window.partitionBy("_chain").orderBy("level"))  # as many rows as levels
    adjusted = F.when(F.col("_chain") & (F.col("score") > 1) & F.col("_next").isNotNull(), F.col("score") / F.greatest("_next", F.lit(0.01))).otherwise(F.col("score"))
    return each.withColumn("_next", following).select("level", "score", adjusted.alias("adjusted")).where("score >= 1")


def table_picks(files: DataFrame) -> DataFrame:
    """level, fid, other: of each level the file with the oldest newest version, and the files of the next level whose keys overlap
    its keys (-1: none, it moves down as it is)."""
    first = files.groupBy("level").agg(F.min(F.struct("max_version", "fid", "min_key", "max_key")).alias("f"))
    below = files.select((F.col("level") - 1).alias("level"), F.col("fid").alias("other"), F.col("min_key").alias("_low"), F.col("max_key").alias("_high"))
    picked = first.select("level", "f.fid", "f.min_key", "f.max_key").join(below, "level", "left")
    meets = (F.col("_low") <= F.col("max_key")) & (F.col("_high") >= F.col("min_key"))
    found = picked.groupBy("level", "fid").agg(F.array_sort(F.collect_list(F.when(meets, F.col("other")))).alias("o"))
    return found.select("level", "fid", F.explode_outer("o").alias("other")).fillna(-1, ["other"])


def level_zero_run(files: DataFrame) -> DataFrame:
    """Files of level 0 that go to the base level together: oldest first, as long as each overlaps the keys of those before it."""
    zero = files.where("level = 0")
    order = Window.orderBy("max_version", "fid")  # level 0 holds a handful of files
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    meets = F.coalesce((F.col("min_key") <= F.max("max_key").over(before)) & (F.col("max_key") >= F.min("min_key").over(before)), F.lit(True))
    return zero.withColumn("_ok", meets.cast("int")).withColumn("_all", F.min("_ok").over(order)).where("_all = 1").select("fid")


def level_zero_merge(files: DataFrame, file_size: int, least_age: int, now_version: int, least: int = 4) -> DataFrame:
    """Files of level 0 that are merged among themselves: under two file sizes and old enough; none if fewer than `least` are."""
    fit = files.where((F.col("level") == 0) & (F.col("size") < 2 * file_size) & (now_version - F.col("max_version") >= least_age)).select("fid")
    return fit.join(F.broadcast(fit.agg(F.count("*").alias("_n")))).where(F.col("_n") >= least).select("fid")


def cut_files(rows: DataFrame, target: int, partitions: int) -> DataFrame:
    """part, file, rows, bytes. rows: part (a split range of keys), key, version, size. In order of key, newest first, a file takes rows
    until it holds `target` bytes. Parts are independent; each is a stream through one task, which holds one file's totals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, file, n, filled = None, 0, 0, 0
        for batch in batches:
            out = []
            for p, size in zip(batch["part"], batch["size"], strict=True):
                if part is not None and (p != part or filled >= target):
                    out.append((part, file, n, filled))
                    file, n, filled = (file + 1 if p == part else 0), 0, 0
                part, n, filled = p, n + 1, filled + int(size)
            yield pd.DataFrame(out, columns=["part", "file", "n_rows", "bytes"])
        if part is not None:
            yield pd.DataFrame([(part, file, n, filled)], columns=["part", "file", "n_rows", "bytes"])

    ordered = rows.repartition(partitions, "part").sortWithinPartitions("part", "key", F.desc("version"))
    return ordered.select("part", "size").mapInPandas(run, "part string, file long, n_rows long, bytes long")
