"""A writable log store: sorted runs as Parquet, and a manifest that says which of them count.

A batch is written to a run of its own; it counts from the moment its change is in the manifest, which is a folder of small Parquet
files added one by one. A run without a change is an orphan, a change without its run is missing data. Batches have numbers; one
that is in the manifest already is not written again, so a stream that is started anew after a failure adds nothing twice.
There is one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata, reads, retention

LOG = "key string, version long, value string, meta int, expires_at long"
CHANGES = "seq long, fid string, op string, level int, batch long, rows long"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        """Open the store at path; an empty or missing folder is a store without rows."""
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def changes(self) -> DataFrame:
        """The manifest's changes so far."""
        path = f"{self.path}/manifest"
        return self.spark.read.schema(CHANGES).parquet(path) if self._exists(path) else self.spark.createDataFrame([], CHANGES)

    def _change(self, rows: list[tuple[str, str, int, int, int]]) -> None:
        """Add changes (fid, op, level, batch, rows) at once: they are one file, which appears whole or not at all."""
        last = self.changes().agg(F.max("seq")).first()[0] or 0
        made = self.spark.createDataFrame([(last + i, *r) for i, r in enumerate(rows, 1)], CHANGES)
        made.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def runs(self) -> DataFrame:
        """fid, level of the runs that count."""
        changes = self.changes()
        return metadata.live_files(changes.select("fid", "seq", "op")).join(changes.where("op = 'CREATE'").select("fid", "level", "batch", "rows"), "fid").select("fid", "level", "batch", "rows")

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        fid = uuid.uuid4().hex
        rows.repartitionByRange("key").sortWithinPartitions("key", F.desc("version")).write.option("compression", "zstd").parquet(f"{self.path}/runs/{fid}")
        return fid, self.spark.read.parquet(f"{self.path}/runs/{fid}").count()

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch of rows as a run of level 0. False if the batch is there already."""
        if not self.changes().where(F.col("batch") == batch).isEmpty():
            return False
        fid, n = self._write(rows.select("key", "version", "value", "meta", "expires_at"))
        self._change([(fid, "CREATE", 0, batch, n)])
        return True

    def sink(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start a streaming query whose micro-batches are appended."""
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda rows, number: self.append(rows, number) and None).start()

    def rows(self) -> DataFrame:
        """All versions of all runs that count. Only their number and names come to the driver."""
        fids = [r.fid for r in self.runs().select("fid").collect()]
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/runs/{f}" for f in fids]) if fids else self.spark.createDataFrame([], LOG)

    def snapshot(self, ts: int, now: int) -> DataFrame:
        return reads.snapshot(self.rows(), ts, now)

    def compact(self, discard_ts: int, versions: int = 1, now: int = 0) -> None:
        """Merge all runs into one of level 1 by the retention rule. The new run and the old ones' end are one change."""
        old = self.runs().collect()
        if not old:
            return
        fid, n = self._write(retention.compact(self.rows(), discard_ts, versions, False, now))
        self._change([(fid, "CREATE", 1, -1, n), *[(r.fid, "DELETE", r.level, r.batch, r.rows) for r in old]])

    def rewrite_due(self, least: int = 10_000, ratio: int = 10) -> bool:
        """Whether deletions in the manifest are many, and many times the runs that count."""
        made, gone = self.changes().agg(F.count(F.when(F.col("op") == "CREATE", 1)), F.count(F.when(F.col("op") == "DELETE", 1))).first()
        return gone > least and gone > ratio * (made - gone)

    def orphans(self) -> DataFrame:
        """Runs in the folder that the manifest doesn't count, and those it counts that are missing."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [(s.getPath().getName(),) for s in fs.listStatus(p)] if fs.exists(p) else []
        return metadata.differences(self.runs(), self.spark.createDataFrame(found, "fid string"))
