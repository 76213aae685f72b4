"""Reads and scans of the log at a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import NOW, dead

ROW = ["key", "version", "value"]


def newest(log: DataFrame, ts: int | None = None) -> DataFrame:
    """The newest row of each key at version ts, dead ones included. The aggregate combines on the map side, so a hot key costs one row a task."""
    seen = log if ts is None else log.where(F.col("version") <= ts)
    return seen.groupBy("key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "key"]), "version").alias("r")).select("key", "r.*")


def snapshot(log: DataFrame, ts: int, now: int = NOW) -> DataFrame:
    return newest(log, ts).where(~dead(now)).select(*ROW)


def snapshot_by_rank(log: DataFrame, ts: int, now: int = NOW) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))
    return log.where(F.col("version") <= ts).withColumn("_r", rank).where("_r = 1").where(~dead(now)).select(*ROW)


def asof(probes: DataFrame, log: DataFrame, now: int = NOW) -> DataFrame:
    """For probes (id, key, ts) the newest row at ts of the key, unless dead. One shuffle by key: rows and probes are merged in version order."""
    row = F.struct("version", "value", "meta", "expires_at")
    left = log.select("key", F.col("version").alias("_at"), F.lit(0).alias("_probe"), F.lit(None).cast("long").alias("id"), row.alias("_row"))
    right = probes.select("key", F.col("ts").alias("_at"), F.lit(1).alias("_probe"), "id", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    found = F.last("_row", ignorenulls=True).over(Window.partitionBy("key").orderBy("_at", "_probe", "id"))
    joined = left.unionByName(right).withColumn("_f", found).where("_probe = 1 and _f is not null").select("id", "key", F.col("_at").alias("ts"), "_f.*")
    return joined.where(~dead(now)).select("id", "key", "ts", "version", "value")


def seek(keys: DataFrame, probes: list[str]) -> DataFrame:
    """For each probe the smallest key not below it and the largest not above it: one aggregate, no sort."""
    cols = []
    for i, p in enumerate(probes):
        cols += [F.min(F.when(F.col("key") >= p, F.col("key"))).alias(f"g{i}"), F.max(F.when(F.col("key") <= p, F.col("key"))).alias(f"l{i}")]
    each = [F.struct(F.lit(p).alias("probe"), F.col(f"g{i}").alias("at_or_after"), F.col(f"l{i}").alias("at_or_before")) for i, p in enumerate(probes)]
    return keys.agg(*cols).select(F.inline(F.array(*each)))


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Rows of all runs; of rows of one key and version that of the first run holds."""
    ranked = None
    for i, r in enumerate(runs):
        r = r.withColumn("_rank", F.lit(i))
        ranked = r if ranked is None else ranked.unionByName(r)
    rest = [c for c in runs[0].columns if c not in ("key", "version")]
    return ranked.groupBy("key", "version").agg(F.min_by(F.struct(*rest), "_rank").alias("r")).select("key", "version", "r.*")


def merge_ordered(*runs: DataFrame) -> DataFrame:
    """All rows of all runs, equal ones too, with their run: by key, newest version first, the first run's rows first."""
    marked = [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)]
    merged = marked[0]
    for r in marked[1:]:
        merged = merged.unionByName(r)
    return merged.orderBy("key", F.desc("version"), "run")


def overlay(snap: DataFrame, pending: DataFrame) -> DataFrame:
    """A transaction's own view: its pending rows (key, version, value, meta) hide the snapshot's."""
    own = newest(pending).select("key", "value", "meta", F.lit(True).alias("own"))
    return snap.select("key", "value").join(own.select("key"), "key", "left_anti").select("key", "value", F.lit(False).alias("own")).union(own.where("meta & 1 = 0").select("key", "value", "own"))
