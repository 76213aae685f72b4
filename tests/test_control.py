"""Codecs, cache, cuts, transactions and the writable store on small cases."""

import random
from collections import OrderedDict

import pandas as pd
from pyspark.sql import functions as F

from palimpsest.functions import codecs
from palimpsest.operators import cache, compaction, reads, transactions
from palimpsest.streaming.store import LOG, Store


def test_checksums():
    assert codecs.crc32c_of(pd.Series([b"123456789", b"", None, bytes(32)])).tolist()[:2] == [0xE3069283, 0]
    assert codecs.crc32c_of(pd.Series([bytes(32)])).tolist() == [0x8A9136AA] and codecs.crc32c_of(pd.Series([None])).isna().all()

    def plain(data):  # from its definition, a byte at a time
        h, m, mask = 0xBC9F1D34 ^ (len(data) * 0xC6A4A793 & 0xFFFFFFFF), 0xC6A4A793, 0xFFFFFFFF
        whole = len(data) // 4 * 4
        for i in range(0, whole, 4):
            h = (h + int.from_bytes(data[i : i + 4], "little")) * m & mask
            h ^= h >> 16
        if rest := data[whole:]:
            h = (h + int.from_bytes(rest, "little")) * m & mask
            h ^= h >> 24
        return h

    r = random.Random(1)
    given = [bytes(r.randrange(256) for _ in range(n % 13)) for n in range(200)]
    assert codecs.hash32_of(pd.Series(given)).tolist() == [plain(x) for x in given]


def test_key_order_and_short_keys(spark):
    keys = spark.createDataFrame([("a", 1), ("a", 2), ("ab", 1), ("", 5), ("é", 2**62)], "key string, version long")
    k = keys.select("key", "version", codecs.encode_key(F.col("key"), F.col("version")).alias("k"))
    got = k.select("key", "version", F.decode(codecs.parse_key(F.col("k")), "utf-8").alias("p"), codecs.parse_version(F.col("k")).alias("v")).collect()
    assert all(r.p == r.key and r.v == (r.version if r.key else 0) for r in got)
    assert spark.range(1).select(codecs.parse_version(F.lit(b"abc")).alias("v"), codecs.parse_key(F.lit(b"abc")).alias("k")).first() == (0, bytearray(b"abc"))
    sizes = spark.createDataFrame([(0, 1), (127, 1), (128, 2), (2**14 - 1, 2), (2**14, 3), (2**62, 9)], "x long, n long")
    assert sizes.where(codecs.varint_bytes(F.col("x")) != F.col("n")).count() == 0


def test_cache_rates():
    r = random.Random(42)
    trace = [r.randrange(200) if r.random() < 0.8 else r.randrange(200, 5200) for _ in range(10_000)]
    c = cache.Cache(1000)
    rate = sum(c.access(k) for k in trace) / len(trace)
    assert 0.75 < rate < 0.88 and len(c.window) + len(c.probation) + len(c.protected) <= 1000
    scan = [k for i in range(3000) for k in (i % 20, 10_000 + i)]  # a scan doesn't push hot keys out
    c, lru, hits = cache.Cache(60), OrderedDict(), 0
    ours = sum(c.access(k) for k in scan)
    for k in scan:
        hits += k in lru
        lru[k] = True
        lru.move_to_end(k)
        if len(lru) > 60:
            lru.popitem(last=False)
    assert ours >= hits - 60 and sum(cache.Cache(100).access(k) for k in []) == 0
    small = cache.Cache(2)
    assert [small.access(k) for k in (1, 1, 1)] == [False, True, True]


def test_cache_over_traces(spark):
    rows = [("a", 5, i, i % 3) for i in range(30)] + [("b", 5, i, i) for i in range(10)]
    got = {r.trace: (r.hits, r.total, r.hit_rate) for r in cache.hit_rates(spark.createDataFrame(rows, "trace string, capacity int, at long, key long")).collect()}
    assert got == {"a": (27, 30, 90.0), "b": (0, 10, 0.0)}
    assert cache.hit_rates(spark.createDataFrame([], "trace string, capacity int, at long, key long")).count() == 0


def test_cuts_and_equal_rows(spark):
    rows = spark.createDataFrame([("p", f"{i:03}", 1, s) for i, s in enumerate([5, 5, 1, 20, 3, 3, 3, 3])] + [("q", "x", 1, 1)], "part string, key string, version long, size long")
    got = sorted((r.part, r.file, r.n_rows, r.bytes) for r in compaction.cut_files(rows, 10, 3).collect())
    assert got == [("p", 0, 2, 10), ("p", 1, 2, 21), ("p", 2, 4, 12), ("q", 0, 1, 1)]
    assert compaction.cut_files(rows.limit(0), 10, 3).count() == 0
    runs = [spark.createDataFrame(x, "key string, version long, value string") for x in ([("a", 1, "x"), ("b", 1, "y")], [("a", 1, "x"), ("a", 2, "z")])]
    assert [tuple(r) for r in reads.merge_ordered(*runs).collect()] == [("a", 2, "z", 1), ("a", 1, "x", 0), ("a", 1, "x", 1), ("b", 1, "y", 0)]


def test_level_targets(spark):
    o = compaction.Options(base_level=10, table=2, memtable=4)
    of = lambda sizes: [(r.target, r.file_size, r.is_base) for r in compaction.level_targets(spark, sizes, o).collect()]
    assert [x[0] for x in of({6: 100_000})] == [0, 10, 10, 100, 1000, 10_000, 100_000]
    assert [i for i, x in enumerate(of({6: 100_000})) if x[2]] == [5]
    assert [i for i, x in enumerate(of({6: 100_000, 3: 5})) if x[2]] == [2]
    assert [i for i, x in enumerate(of({})) if x[2]] == [6]


def test_watermark_waits_for_the_oldest(spark):
    spans = spark.createDataFrame([(0, 1, 50), (0, 2, 20), (0, 3, 60), (1, 1, 5)], "shard int, idx long, done_at long")
    assert sorted(map(tuple, transactions.watermark(spans).collect())) == [(0, 20, 0), (0, 50, 2), (0, 60, 3), (1, 5, 1)]


def test_store_survives_reopening_and_takes_a_batch_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    log = lambda rows: spark.createDataFrame([(k, v, x, 0, 0) for k, v, x in rows], LOG)
    store = Store(spark, path)
    assert store.rows().count() == 0 and store.append(log([("b", 1, "x"), ("a", 2, "y")]), 0)
    assert not store.append(log([("b", 1, "x")]), 0) and store.append(log([("b", 3, "z")]), 1)
    again = Store(spark, path)
    assert sorted((r.key, r.version) for r in again.rows().collect()) == [("a", 2), ("b", 1), ("b", 3)]
    again.compact(2**62)
    assert sorted((r.key, r.value) for r in Store(spark, path).snapshot(10, 1).collect()) == [("a", "y"), ("b", "z")]
    assert again.runs().select("level").first().level == 1 and {r.kind for r in again.orphans().collect()} == {"orphan"} and not again.rewrite_due()
    assert not again.append(log([("b", 1, "x")]), 1)  # known from before the compaction


def test_store_takes_a_stream(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    store = Store(spark, f"file://{tmp_path}/store")
    for part in (1, 2):
        spark.createDataFrame([(f"k{i}", part, "v", 0, 0) for i in range(5)], LOG).coalesce(1).write.mode("append").parquet(folder)
        query = store.sink(spark.readStream.schema(LOG).parquet(folder), f"file://{tmp_path}/checkpoint")
        query.awaitTermination()
    assert store.rows().count() == 10 and {r.batch for r in store.runs().collect()} == {0, 1}
