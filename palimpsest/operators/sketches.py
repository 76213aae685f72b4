"""Bloom filter and count-min sketch as bit and counter tables, and prefix compression of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits and probes of the filter; width, multipliers and ceiling of the counters; keys of a block.
BITS, PROBES = 16384, 7
WIDTH, MULTIPLIERS, CEILING = 256, (40503, 30011, 20011, 10007), 15
BLOCK = 16
#: ln 2, as the size formula has it.
LN2 = 0.69314718056


def positions(key: Column) -> Column:
    """Double hashing: start and step are multiplicative hashes, the same arithmetic in any engine."""
    start, step = (key * 40503) % 1000003, (key * 30011) % 65521 + 1
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: (start + i * step) % BITS)


def bloom_bits(keys: DataFrame) -> DataFrame:
    return keys.select(F.explode(positions(F.col("key"))).alias("bit")).groupBy("bit").agg(F.count("*").alias("n_set"))


def bloom_size(keys: DataFrame, rates: list[float]) -> DataFrame:
    """fp, keys, bits_per_key, probes and bytes of the filter for each rate of false positives."""
    n = keys.agg(F.count("*").alias("keys")).withColumn("fp", F.explode(F.array(*[F.lit(x) for x in rates])))
    b = n.select("fp", "keys", F.ceil(-F.log("fp") / (LN2 * LN2)).cast("long").alias("bits_per_key"))
    probes = F.least(F.lit(30), F.greatest(F.lit(1), F.floor(F.col("bits_per_key") * 0.69)))
    return b.select("*", probes.cast("long").alias("probes"), F.expr("(greatest(64, keys * bits_per_key) + 7) div 8").cast("long").alias("bytes"))


def bloom_probe(keys: DataFrame, bits: DataFrame) -> DataFrame:
    """key, maybe. The bits are at most BITS rows and are broadcast."""
    each = keys.select("key", F.explode(F.array_distinct(positions(F.col("key")))).alias("bit"))
    return each.join(F.broadcast(bits.select("bit", F.lit(1).alias("_one"))), "bit", "left").groupBy("key").agg(F.min(F.coalesce("_one", F.lit(0))).alias("maybe"))


def _slots() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("row"), ((F.col("key") * m + i) % 1000003 % WIDTH).alias("slot")) for i, m in enumerate(MULTIPLIERS)])


def counters(keys: DataFrame) -> DataFrame:
    """row, slot, c: len(MULTIPLIERS) * WIDTH rows at most, each counter at most CEILING."""
    return keys.select(F.inline(_slots())).groupBy("row", "slot").agg(F.least(F.count("*"), F.lit(CEILING)).alias("c"))


def count_min(keys: DataFrame) -> DataFrame:
    """key, estimate: the least of its counters. Counters are few and are broadcast."""
    return keys.select("key").distinct().select("key", F.inline(_slots())).join(F.broadcast(counters(keys)), ["row", "slot"]).groupBy("key").agg(F.min("c").alias("estimate"))


def prefix_compression(keys: DataFrame) -> DataFrame:
    """Per block (keys of block, key): keys, bytes and the bytes that the prefix shared with the block's first key saves."""
    base = F.min("key").over(Window.partitionBy("block"))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i) == F.substring(F.col("_base"), F.lit(1), i)))
    saved = F.when(F.col("key") == F.col("_base"), 0).otherwise(shared)
    return keys.withColumn("_base", base).groupBy("block").agg(F.count("*").alias("n_keys"), F.sum(F.length("key")).cast("long").alias("bytes"), F.sum(saved).cast("long").alias("saved"))
