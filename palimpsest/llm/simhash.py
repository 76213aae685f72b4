"""Near-duplicates by SimHash, found with Golay codes.

A 64-bit fingerprint is cut into three segments of at most 23 bits, the length of the perfect binary Golay code. Two fingerprints
with at most two differing bits have, in some cyclic pair of neighbouring segments, no error in the first and at most one in the
second (checked for all patterns in the tests). Of a 23-bit segment the home key is the index of the one codeword within three
bits, and the probe keys are the indices of all codewords within four (5.3 on average): one error moves the home of the one
fingerprint at most into the probes of the other. So a join of probes with homes, on the first segment's bits and the second's
codeword, misses no link; candidates are then verified on all 64 bits.

Equal fingerprints are one node from the start. A key with many homes is not joined: its fingerprints meet at shared one-bit
flips instead, which is as exact, and makes 65 rows a fingerprint however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

WIDTH, SEED, MOST_BITS = 3, 42, 2
#: Low bit and bits of the segments; each is followed by the next, the last by the first.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Homes of a key that are joined; beyond, its fingerprints meet at one-bit flips.
MOST_HOMES = 4
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's shingles: a bit is 1 if set in over half of their hashes."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < WIDTH:
        return h(b" ".join(words), SEED)
    joined, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    counts, n = np.zeros(64, np.int64), len(words) - WIDTH + 1
    for low in range(0, n, 65536):
        high = min(n, low + 65536)
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[low:high], ends[low + WIDTH - 1 : high + WIDTH - 1], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; by syndrome, the one error of at most 3 bits; all errors of at most 4."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int64)
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[low[e & 0xFFF] ^ high[e >> 12]].append(e)
    most = max(map(len, errors))
    table = np.array([x + [-1] * (most - len(x)) for x in errors], np.int64)
    return low, high, table[:, 0].copy(), table  # in order of weight, so the first is the one within 3 bits


def home_index(segment: np.ndarray) -> np.ndarray:
    low, high, nearest, _ = golay()
    return (segment ^ nearest[low[segment & 0xFFF] ^ high[segment >> 12]]) >> 11


def probe_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices: all codewords within 4 bits of each segment."""
    low, high, _, every = golay()
    errors = every[low[segment & 0xFFF] ^ high[segment >> 12]]
    rows, columns = np.nonzero(errors >= 0)
    return rows, (segment[rows] ^ errors[rows, columns]) >> 11


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        parts = [(fp.view(np.uint64) >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
        keys, prints, homes = [], [], []
        for i in range(3):
            exact, near = parts[i] << 12 | i << 36, parts[(i + 1) % 3]
            rows, index = probe_indices(near)
            keys += [exact | home_index(near), exact[rows] | index]
            prints += [fp, fp[rows]]
            homes += [np.ones(len(fp), bool), np.zeros(len(rows), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, prints, homes)], names=["key", "fp", "home"])


def links(prints: DataFrame, most_homes: int = MOST_HOMES) -> DataFrame:
    """Links (u, v) that connect all of the distinct fingerprints of column fp that differ in at most MOST_BITS bits: each is such a
    pair, and any other such pair is connected through a chain of them."""
    keys = cut(prints.select("fp").mapInArrow(_keys, "key long, fp long, home boolean"))
    homes = keys.where("home").select("key", F.col("fp").alias("v"))
    sizes = homes.groupBy("key").agg(F.count("*").alias("n"))
    probes = keys.where("not home").select("key", F.col("fp").alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS
    sized = homes.join(sizes, "key")
    pairs = probes.join(sized.where(F.col("n") <= most_homes), "key").where("u <> v").where(near).select("u", "v")
    hot = probes.join(sizes.where(F.col("n") > most_homes), "key").select(F.col("u").alias("fp")).union(sized.where(F.col("n") > most_homes).select(F.col("v").alias("fp"))).distinct()
    flips = hot.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))))).alias("at"))
    centre = flips.groupBy("at").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("at", "v")
    return pairs.union(flips.join(centre, "at").where("fp <> v").select(F.col("fp").alias("u"), "v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row of docs; other columns are not read.

    component_id is the smallest doc_id among all documents reachable over links of at most MOST_BITS differing bits, itself
    included. A text without words (null, empty, white space) has fingerprint zero, linked like any other. A null doc_id is never
    the smallest; a component of nulls only has a null component_id. Repeated rows share a component. An empty table gives no rows.
    """
    prints = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
