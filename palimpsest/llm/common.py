"""What several operators share: table access, shared scratch space, word patterns."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words, and the patterns built on them.
SPACE = " \t\n\x0b\x0c\r"
NOT_SPACE_RE = r"[^\x20\x09-\x0D]"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Setting by which Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only where it is unset (tests) one under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    with cleaned_up(df.sparkSession):
        return df.checkpoint()


@contextlib.contextmanager
def cleaned_up(spark: SparkSession):
    """Shuffle files of the actions inside go with the end of each."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df, compressed, to a fresh path in the shared folder and read it from there. Gives the frame and the path.

    The shuffle files that the write needed go with its end, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trimmed(batches: Iterator) -> Iterator:
    """The same batches; at their end the Python worker, which outlives the task, gives unused memory back to the system."""
    yield from batches
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text):
    """Array of the words of a string column; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
