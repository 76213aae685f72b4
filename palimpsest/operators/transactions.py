"""Transactions: validation, last writes, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def schedule(orders: DataFrame, shards: int = 16, open_for: int = 17) -> DataFrame:
    """txn, shard, begin and commit: each shard's orders one after another, begun at even times and open for a while. Places in a shard are counted by day and over the table of days."""
    o = orders.select(F.col("o_orderkey").alias("txn"), (F.col("o_custkey") % shards).alias("shard"), "o_orderdate").withColumn("_day", F.to_date("o_orderdate"))
    days = o.groupBy("shard", "_day").agg(F.count("*").alias("_n"))
    before = days.select("shard", "_day", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_day")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_day").orderBy("o_orderdate", "txn"))
    place = F.col("_before") + rank
    return o.join(before, ["shard", "_day"]).select("txn", "shard", (2 * place).alias("begin"), (2 * place + open_for).alias("commit"))


def conflict_edges(txns: DataFrame, reads: DataFrame, writes: DataFrame, open_for: int = 17) -> DataFrame:
    """(txn, other): other committed while txn was open and wrote what txn read. Commits are met by cells of time, so that a hot key is joined with what is near in time only."""
    r = reads.join(txns, "txn").select("shard", "key", F.col("txn"), "begin", "commit", F.explode(F.sequence(F.expr(f"begin div {open_for}"), F.expr(f"commit div {open_for}"))).alias("_cell"))
    w = writes.join(txns, "txn").select("shard", "key", F.col("txn").alias("other"), F.col("commit").alias("other_commit"), F.expr(f"commit div {open_for}").alias("_cell"))
    return r.join(w, ["shard", "key", "_cell"]).where("txn <> other and begin < other_commit and other_commit < commit").select("txn", "other").distinct()


def outcomes(txns: DataFrame, edges: DataFrame, cut) -> DataFrame:
    """txn, outcome: a transaction aborts if one that it has an edge to commits. Settled from those without open edges outwards;
    a round is one join, rounds are as many as the longest chain. cut writes a frame to shared storage."""
    todo = cut(edges)
    aborted = None
    while True:
        waits = todo.select(F.col("txn").alias("other")).distinct()
        settled = todo.join(waits, "other", "left_anti")  # edges to transactions that wait for nothing, so commit
        lost = cut(settled.select("txn").distinct())
        aborted = lost if aborted is None else aborted.union(lost)
        if not lost.limit(1).count():
            break
        todo = cut(todo.join(lost, "txn", "left_anti").join(lost.withColumnRenamed("txn", "other"), "other", "left_anti"))
    return txns.select("txn").join(aborted.withColumn("_a", F.lit(1)), "txn", "left").select("txn", F.when(F.col("_a").isNull(), "committed").otherwise("conflict").alias("outcome"))


#: Operations of a transaction's batch at most, bytes of them, and bytes of a key.
MOST_OPS, MOST_BYTES, MOST_KEY = 5, 200_000, 65_000


def validated(ops: DataFrame) -> DataFrame:
    """txn, seq, outcome of each write of an op-log (txn, seq, op: set or discard, read_only, key_bytes, value_bytes), in the order of
    checks: read-only, discarded, empty key, key too long, batch too big. What is refused takes no room of the batch, so the last
    check is a fold over the transaction's operations, in the JVM; a transaction has few."""
    size = F.col("key_bytes") + F.col("value_bytes")
    each = ops.groupBy("txn", "read_only").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "key_bytes", size.alias("size")))).alias("ops"))
    start = F.struct(F.lit(False).alias("gone"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<struct<seq:bigint,outcome:string>>").alias("out"))

    def step(a, x):
        too_big = (a["n"] + 1 >= MOST_OPS) | (a["bytes"] + x["size"] >= MOST_BYTES)
        outcome = F.when(F.col("read_only"), "read_only").when(a["gone"], "discarded").when(x["key_bytes"] == 0, "empty_key").when(x["key_bytes"] > MOST_KEY, "key_too_long").when(too_big, "too_big").otherwise("ok")
        write = x["op"] == "set"
        taken = write & (outcome == "ok")
        out = F.when(write, F.concat(a["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), outcome.alias("outcome"))))).otherwise(a["out"])
        return F.struct((a["gone"] | (x["op"] == "discard")).alias("gone"), (a["n"] + taken.cast("long")).alias("n"), (a["bytes"] + F.when(taken, x["size"]).otherwise(0)).cast("long").alias("bytes"), out.alias("out"))

    return each.select("txn", F.explode(F.aggregate("ops", start, step)["out"]).alias("o")).select("txn", "o.seq", "o.outcome")


def tracked_reads(ops: DataFrame) -> DataFrame:
    """txn, key of the reads that count for conflicts: of update transactions, not served by an own earlier write.
    ops: txn, seq, op (get or set), read_only, key."""
    first = F.min(F.when(F.col("op") == "set", F.col("seq"))).over(Window.partitionBy("txn", "key"))
    marked = ops.withColumn("_w", first).where("op = 'get' and not read_only and (_w is null or seq < _w)")
    return marked.select("txn", "key").distinct()


def commit_numbers(outcomes: DataFrame, txns: DataFrame) -> DataFrame:
    """txn, commit_ts: committed transactions of a shard are numbered in commit order; those that conflict take no number."""
    done = outcomes.where("outcome = 'committed'").join(txns, "txn")
    return done.select("txn", F.row_number().over(Window.partitionBy("shard").orderBy("commit")).cast("long").alias("commit_ts"))


def watermark(spans: DataFrame) -> DataFrame:
    """shard, at, done_until: after each end (shard, idx, done_at) the largest index such that it and all before it have ended; 0
    if none. An index is covered from the latest end up to it on; ends and these times are merged in time order."""
    covered = spans.select("shard", "idx", F.max("done_at").over(Window.partitionBy("shard").orderBy("idx")).alias("at"))
    events = covered.select("shard", "at", F.lit(0).alias("kind"), "idx").union(spans.select("shard", F.col("done_at").alias("at"), F.lit(1), F.lit(None).cast("long")))
    seen = F.max("idx").over(Window.partitionBy("shard").orderBy("at", "kind"))
    return events.withColumn("done_until", seen).where("kind = 1").select("shard", "at", F.coalesce("done_until", F.lit(0)).cast("long").alias("done_until")).distinct()


def forgotten(committed: DataFrame, active: DataFrame) -> DataFrame:
    """Committed transactions (shard, txn, commit) that no active one (shard, begin) can conflict with any more."""
    oldest = active.groupBy("shard").agg(F.min("begin").alias("_oldest"))
    return committed.join(oldest, "shard", "left").where("_oldest is null or commit <= _oldest").select("shard", "txn")
