"""Retention of versions (compaction) and the statistics of runs and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import NOW, dead


def judged(log: DataFrame, discard_ts: int, versions: int, overlap: bool, now: int = NOW) -> DataFrame:
    """log with `keep`. Rows above discard_ts stay. Below, the first dead row or the versions-th row closes its key; what is older goes, and a dead closing row stays only while a deeper level overlaps."""
    newest_first = Window.partitionBy("key").orderBy(F.desc("version"))
    old = F.col("version") <= discard_ts
    marked = log.withColumn("_dead", dead(now)).withColumn("_old", old.cast("int"))
    placed = marked.withColumn("_pos", F.sum("_old").over(newest_first)).withColumn("_prior", F.coalesce(F.sum((old & F.col("_dead")).cast("int")).over(newest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keep = ~old | ((F.col("_pos") <= versions) & (F.col("_prior") == 0) & (~F.col("_dead") | F.lit(overlap)))
    return placed.withColumn("keep", keep).drop("_dead", "_old", "_pos", "_prior")


def compact(log: DataFrame, discard_ts: int, versions: int = 1, overlap: bool = False, now: int = NOW) -> DataFrame:
    return judged(log, discard_ts, versions, overlap, now).where("keep").drop("keep")


def run_stats(log: DataFrame, per_run: int = 500) -> DataFrame:
    return log.groupBy(F.expr(f"version div {per_run}").alias("fid")).agg(F.count("*").alias("key_count"), F.max("version").alias("max_version"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(F.length("key") + F.length("value") + 8).cast("long").alias("size"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of files with overlapping key ranges. Each file is sent to the cells of keys that it touches, so files meet by equality; a
    pair is taken in the first cell it shares. A file takes cells of its own size: the power of two at or above its width, two cells at
    most, and is looked for by the other side at all the sizes that occur there, of which there are 64 at most."""
    wide = lambda low, high: F.ceil(F.log2(F.greatest(high - low + 1, F.lit(1)).cast("double"))).cast("int")
    named = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in ("fid", "min_key", "max_key")], wide(F.col("min_key"), F.col("max_key")).alias(p + "w"))
    left, right = named(a, "a_"), named(b, "b_")
    found = None
    for p, one, q, other, strict in (("a_", left, "b_", right, False), ("b_", right, "a_", left, True)):
        # the wider file of a pair (of equal ones the left) sets the size of the cells, so the narrower one touches two at most
        sizes = [r[0] for r in one.select(p + "w").distinct().collect()]
        own = one.withColumn("_w", F.col(p + "w")).withColumn("_cell", F.explode(F.expr(f"sequence(shiftright({p}min_key, _w), shiftright({p}max_key, _w))")))
        sought = other.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in sizes] or [F.lit(0)]))).where(F.col("_w") > F.col(q + "w") if strict else F.col("_w") >= F.col(q + "w"))
        sought = sought.withColumn("_cell", F.explode(F.expr(f"sequence(shiftright({q}min_key, _w), shiftright({q}max_key, _w))")))
        pairs = own.join(sought, ["_w", "_cell"]).where("a_min_key <= b_max_key and a_max_key >= b_min_key")
        pairs = pairs.where(F.expr("_cell = shiftright(greatest(a_min_key, b_min_key), _w)")).select("a_fid", "b_fid")
        found = pairs if found is None else found.union(pairs)
    return found


def split_ranges(files: DataFrame, least: int = 3, parts: int = 5) -> DataFrame:
    """Every width-th file, and the last one, ends a range; width = max(least, ceil(n / parts)). The list of files is metadata."""
    n = files.count()
    width = max(least, -(-n // parts))
    numbered = files.withColumn("_i", F.row_number().over(Window.orderBy("min_key")) - 1)
    return numbered.where((F.col("_i") % width == width - 1) | (F.col("_i") == n - 1)).select("fid", F.col("max_key").alias("boundary"))


def stale_by_level(log: DataFrame, files: DataFrame, per_run: int = 100) -> DataFrame:
    """level, size, stale: bytes of a level's files, and those of tombstones in them (key, value and version)."""
    stale = log.where("meta & 1 = 1").groupBy(F.expr(f"version div {per_run}").alias("fid")).agg(F.sum(F.length("key") + F.length("value") + 8).cast("long").alias("stale"))
    return files.join(stale, "fid", "left").groupBy("level").agg(F.sum("size").cast("long").alias("size"), F.sum(F.coalesce("stale", F.lit(0))).cast("long").alias("stale"))
