"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn level by level.

Each node of the tree draws -ln(u)/weight with u hashed from (key, node); the smallest draw wins. A node's weight is the sum
of its shards' weights. A draw depends on nothing but the key, the node's name and its weight, so a changed weight moves keys
only into or out of the nodes on the path to what changed: elsewhere all draws stay as they were.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows that one task may number at most, on average.
ROWS_PER_BUCKET = 500_000


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int | None = None
    total: float = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "total", sum(c.total for c in self.children) if self.children else self.weight)


def tree(n_shards: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> Node:
    """The tree for a shard count. The first `base` shards fill regions of racks * per_rack; every shard past them stands in a region of its own, so that one more shard takes keys from all regions and gives none."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    regions, per_region = [], racks * per_rack
    for start in range(0, min(n_shards, base), per_region):
        ids = range(start, min(start + per_region, n_shards, base))
        groups = [ids[i : i + per_rack] for i in range(0, len(ids), per_rack)]
        regions.append(Node(f"region{start}", children=tuple(Node(f"rack{g[0]}", children=tuple(Node(f"shard{s}", shard=s) for s in g)) for g in groups)))
    regions += [Node(f"region{s}", children=(Node(f"rack{s}", children=(Node(f"shard{s}", shard=s),)),)) for s in range(base, n_shards)]
    return Node("root", children=tuple(regions))


def _unit(key, name: str):
    """A number in (0, 1) for a key and a node."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def place(key, node: Node):
    """Column: the shard of a key. Only the children of the node that won are drawn."""
    live = [c for c in node.children if c.total > 0]
    if not node.children:
        return F.lit(node.shard)
    if len(live) == 1:
        return place(key, live[0])
    draws = F.array_min(F.array(*[F.struct((-F.log(_unit(key, c.name)) / F.lit(c.total)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
    if all(c.shard is not None for c in live):
        return F.element_at(F.array(*[F.lit(c.shard) for c in live]), draws + 1)
    out = F.when(draws == 0, place(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(draws == i, place(key, c))
    return out


def shard_documents(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", root: Node | None = None, grown: Node | None = None) -> DataFrame:
    """Give each row a shard, a gapless slot in it and the shard it has once one more shard is there.

    Returns doc_id, size (bytes of the text plus 8), text_crc32, law ('key'), shard, slot, grown_shard; no other column of docs
    is read. Null text: empty. A null key is a key like any other. Repeated rows fall into one shard, each with a slot of its
    own. An empty table gives no rows. Slots follow the hash of the key, then the key, then size and checksum.

    Slots need no task that holds a shard: keys are dealt by hash to buckets of about ROWS_PER_BUCKET rows, rows are numbered in
    their bucket, and the bucket's offset is a running sum over the small table of bucket counts.
    """
    root, grown = root or tree(n_shards), grown or tree(n_shards + 1)
    k = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00null"))
    placed = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select(
        "doc_id",
        (F.octet_length("t") + 8).cast("long").alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(k, root).cast("int").alias("shard"),
        place(k, grown).cast("int").alias("grown_shard"),
        F.xxhash64(F.lit("slot"), k).alias("_h"),
    )
    n = docs.count()
    buckets = max(1, -(-n // (ROWS_PER_BUCKET * n_shards)), 4)
    placed = placed.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_h", "doc_id", "size", "text_crc32")))
    return ranked.join(before, ["shard", "_b"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_r") - 1).cast("long").alias("slot"), "grown_shard")


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def check_movement(old: Counter, new: Counter) -> dict[int, int]:
    """By shard: rows gained (or lost, below 0)."""
    return {s: new[s] - old[s] for s in {*old, *new}}
