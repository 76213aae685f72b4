"""Queries of compaction control, transactions over an op-log, codecs, cache and the writable store, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import cache, compaction, metadata, reads, retention, sketches, transactions, values
from ..sources.views import NOW, kv_log, read_ts, table
from ..streaming.store import Store
from .catalogue import CHANGES, CMS_SQL, EDGE_SQL, LOG, NOW_SQL, TXN, VLOG, _changes, _docs, _edges, _judged_sql, _live, checkpoints, query

FILES = """runs AS (SELECT version // 100 AS fid, count(*) AS key_count, max(version) AS max_version, min(key) AS min_key, max(key) AS max_key, CAST(sum(length(key) + length(value) + 8) AS BIGINT) AS size FROM log GROUP BY 1),
files AS (SELECT CAST(least(((SELECT max(fid) FROM runs) - fid) // 3, 6) AS INTEGER) AS level, * FROM runs)"""
OPTIONS = compaction.Options()
TARGETS = f"""lv AS (SELECT unnest(range(7)) AS level), tot AS (SELECT level, coalesce((SELECT CAST(sum(size) AS BIGINT) FROM files f WHERE f.level = lv.level), 0) AS total FROM lv),
tg AS (SELECT level, total, CASE WHEN level = 0 THEN 0 ELSE greatest({OPTIONS.base_level}, (SELECT total FROM tot WHERE level = 6) // CAST(power({OPTIONS.level_multiplier}, 6 - level) AS BIGINT)) END AS target FROM tot),
b0 AS (SELECT coalesce(max(level), 0) AS base FROM tg WHERE level > 0 AND target <= {OPTIONS.base_level}),
fs AS (SELECT level, total, target, base, CASE WHEN level = 0 THEN {OPTIONS.memtable} ELSE {OPTIONS.table} * CAST(power({OPTIONS.table_multiplier}, greatest(0, level - base)) AS BIGINT) END AS file_size FROM tg, b0),
b1 AS (SELECT coalesce((SELECT min(level) - 1 FROM fs WHERE level > base AND level < 6 AND total > 0), greatest((SELECT base FROM b0), 5)) AS base),
b2 AS (SELECT base + CASE WHEN base < 6 AND (SELECT total FROM fs WHERE level = b1.base) = 0 AND (SELECT total < file_size FROM fs WHERE level = b1.base + 1) THEN 1 ELSE 0 END AS base FROM b1),
targets AS (SELECT CAST(level AS INTEGER) AS level, CAST(target AS BIGINT) AS target, CAST(file_size AS BIGINT) AS file_size, level = (SELECT base FROM b2) AS is_base FROM fs)"""


def _files(spark, sf_dir):
    return compaction.level_files(kv_log(spark, sf_dir))


def _targets(spark, sf_dir):
    sizes = {r.level: r.size for r in _files(spark, sf_dir).groupBy("level").agg(F.sum("size").alias("size")).collect()}  # seven levels
    return compaction.level_targets(spark, sizes)


@query(f"WITH {LOG}, {FILES}, {TARGETS} SELECT level, target, file_size, is_base FROM targets")
def level_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


@query(f"""WITH {LOG}, {FILES}, {TARGETS}, s AS (SELECT t.level, CASE WHEN t.level = 0 THEN (SELECT count(*) FROM files f WHERE f.level = 0) / CAST({OPTIONS.level_zero_tables} AS DOUBLE) ELSE coalesce((SELECT CAST(sum(size) AS BIGINT) FROM files f WHERE f.level = t.level), 0) / CAST(t.target AS DOUBLE) END AS score FROM targets t),
c AS (SELECT s.*, (SELECT n.score FROM s n WHERE n.level = (SELECT min(level) FROM s m WHERE m.level > s.level AND m.level >= (SELECT base FROM b2))) AS following, level = 0 OR level >= (SELECT base FROM b2) AS chain FROM s)
SELECT level, score, CASE WHEN chain AND score > 1 AND following IS NOT NULL THEN score / greatest(following, 0.01) ELSE score END AS adjusted FROM c WHERE score >= 1""")
def compaction_scores(spark, sf_dir):
    return compaction.compaction_scores(_files(spark, sf_dir), _targets(spark, sf_dir))


@query(f"""WITH {LOG}, {FILES}, p AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY level ORDER BY max_version, fid) = 1)
SELECT p.level, p.fid, coalesce(n.fid, -1) AS other FROM p LEFT JOIN files n ON n.level = p.level + 1 AND n.min_key <= p.max_key AND n.max_key >= p.min_key""")
def table_pick(spark, sf_dir):
    return compaction.table_picks(_files(spark, sf_dir))


@query(f"""WITH RECURSIVE {LOG}, {FILES}, z AS (SELECT *, row_number() OVER (ORDER BY max_version, fid) AS r FROM files WHERE level = 0),
w AS (SELECT r, fid, min_key AS low, max_key AS high FROM z WHERE r = 1 UNION ALL SELECT z.r, z.fid, least(low, z.min_key), greatest(high, z.max_key) FROM w JOIN z ON z.r = w.r + 1 AND z.min_key <= w.high AND z.max_key >= w.low) SELECT fid FROM w""")
def level_zero_run(spark, sf_dir):
    return compaction.level_zero_run(_files(spark, sf_dir))


@query(f"WITH {LOG}, {FILES}, fit AS (SELECT fid FROM files WHERE level = 0 AND size < 40000 AND (SELECT max(version) FROM log) - max_version >= 50) SELECT fid FROM fit WHERE (SELECT count(*) FROM fit) >= 2")
def level_zero_merge(spark, sf_dir):
    top = kv_log(spark, sf_dir).agg(F.max("version")).first()[0] or 0
    return compaction.level_zero_merge(_files(spark, sf_dir), 20_000, 50, top, 2)


@query(f"WITH {LOG}, {FILES} SELECT level, min(min_key) AS low, max(max_key) AS high, count(*) AS n_files FROM files GROUP BY level")
def level_hull(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("level").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"), F.count("*").alias("n_files"))


@query(f"""WITH RECURSIVE {LOG}, s AS (SELECT key[1:2] AS part, length(key) + length(value) + 8 AS size, row_number() OVER (PARTITION BY key[1:2] ORDER BY key, version DESC) AS r FROM log),
f AS (SELECT part, r, CAST(0 AS BIGINT) AS file, CAST(size AS BIGINT) AS filled FROM s WHERE r = 1 UNION ALL
SELECT s.part, s.r, CASE WHEN f.filled >= 1500 THEN f.file + 1 ELSE f.file END, CASE WHEN f.filled >= 1500 THEN s.size ELSE f.filled + s.size END FROM f JOIN s ON s.part = f.part AND s.r = f.r + 1)
SELECT part, file, count(*) AS n_rows, max(filled) AS bytes FROM f GROUP BY part, file""")
def output_file_cut(spark, sf_dir):
    rows = kv_log(spark, sf_dir).select(F.substring("key", 1, 2).alias("part"), "key", "version", (F.length("key") + F.length("value") + 8).cast("long").alias("size"))
    return compaction.cut_files(rows, 1500, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@query(f"WITH {LOG} SELECT key, version, value FROM log ORDER BY key, version DESC")
def all_versions(spark, sf_dir):
    return kv_log(spark, sf_dir).select(*reads.ROW).orderBy("key", F.desc("version"))


@query(f"WITH {LOG} SELECT key, version, value, 1 AS run FROM log UNION ALL SELECT key, version, upper(value), 0 FROM log WHERE version % 3 = 0 ORDER BY 1, 2 DESC, 4")
def merge_ordered(spark, sf_dir):
    log = kv_log(spark, sf_dir).select(*reads.ROW)
    return reads.merge_ordered(log.where("version % 3 = 0").withColumn("value", F.upper("value")), log)


@query(f"WITH {LOG} SELECT key, version, key AS parsed_key, version AS parsed_version, lead(version, 1, 0) OVER (PARTITION BY key ORDER BY version DESC) AS next_in_key FROM log")
def key_codec_roundtrip(spark, sf_dir):
    from pyspark.sql import Window

    keys = kv_log(spark, sf_dir).select("key", "version", codecs.encode_key(F.col("key"), F.col("version")).alias("_k"))
    parsed = keys.select("key", "version", F.decode(codecs.parse_key(F.col("_k")), "utf-8").alias("parsed_key"), codecs.parse_version(F.col("_k")).alias("parsed_version"), "_k")
    return parsed.withColumn("next_in_key", F.lead("parsed_version", 1, 0).over(Window.partitionBy("parsed_key").orderBy("_k"))).drop("_k")


@query(f"""WITH {LOG}, n AS (SELECT key, version, length(key) AS k, length(value) AS v, expires_at AS e FROM log)
SELECT key, version, CAST(1 + ceil(length(bin(k + 8)) / 7.0) + ceil(length(bin(v)) / 7.0) + ceil(length(bin(e)) / 7.0) + k + 8 + v + 4 AS BIGINT) AS bytes FROM n""")
def record_sizes(spark, sf_dir):
    size = codecs.record_bytes(F.octet_length("key"), F.octet_length("value"), F.col("expires_at"))
    return kv_log(spark, sf_dir).select("key", "version", size.cast("long").alias("bytes"))


@query(f'WITH {VLOG} SELECT key, len AS length, off AS "offset", fid, len AS decoded_length, off AS decoded_offset, fid AS decoded_fid FROM vlog')
def pointer_roundtrip(spark, sf_dir):
    log = values.placed(_docs(spark, sf_dir)).select("key", F.col("len").alias("length"), "offset", "fid")
    found = log.withColumn("_p", codecs.decode_pointer(codecs.encode_pointer(F.col("length"), F.col("offset"), F.col("fid"))))
    return found.select("key", "length", "offset", "fid", *[F.col(f"_p.{c}").alias(f"decoded_{c}") for c in ("length", "offset", "fid")])


@query(f"WITH {LOG}, {FILES} SELECT fid, lpad(CAST(fid AS VARCHAR), 5, '0') || '.sst' AS name FROM files")
def file_names(spark, sf_dir):
    return _files(spark, sf_dir).select("fid", codecs.file_name(F.col("fid")).alias("name"))


@query()
def checksums(spark, sf_dir):
    """Bit arithmetic over bytes: tested against a loop and known values."""
    return kv_log(spark, sf_dir).select("key", "version", codecs.crc32c(F.encode("value", "utf-8")).alias("crc"), codecs.hash32(F.encode("key", "utf-8")).alias("hash"))


OPS = """ops AS (SELECT l_orderkey AS txn, CAST(l_linenumber AS BIGINT) AS seq, CASE WHEN l_partkey % 19 = 0 THEN 'discard' ELSE 'set' END AS op, l_orderkey % 9 = 0 AS read_only,
CAST(CASE WHEN l_partkey % 13 = 0 THEN 0 WHEN l_partkey % 17 = 0 THEN 65001 ELSE 8 END AS BIGINT) AS key_bytes, CAST(l_extendedprice AS BIGINT) AS value_bytes FROM lineitem)"""


def _ops(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as txn", "cast(l_linenumber as bigint) as seq", "case when l_partkey % 19 = 0 then 'discard' else 'set' end as op", "l_orderkey % 9 = 0 as read_only", "cast(case when l_partkey % 13 = 0 then 0 when l_partkey % 17 = 0 then 65001 else 8 end as bigint) as key_bytes", "cast(round(l_extendedprice) as bigint) as value_bytes")


@query(f"""WITH RECURSIVE {OPS.replace('CAST(l_extendedprice AS BIGINT)', 'CAST(round(l_extendedprice) AS BIGINT)')}, o AS (SELECT *, row_number() OVER (PARTITION BY txn ORDER BY seq, op, key_bytes, key_bytes + value_bytes) AS r, key_bytes + value_bytes AS size FROM ops),
f AS (SELECT txn, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS seq, '' AS op, '' AS outcome, false AS gone, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS bytes FROM (SELECT DISTINCT txn FROM ops) UNION ALL
SELECT txn, r, seq, op, outcome, gone OR op = 'discard', n + CASE WHEN op = 'set' AND outcome = 'ok' THEN 1 ELSE 0 END, bytes + CASE WHEN op = 'set' AND outcome = 'ok' THEN size ELSE 0 END FROM
(SELECT o.txn, o.r, o.seq, o.op, o.size, f.gone, f.n, f.bytes, CASE WHEN o.read_only THEN 'read_only' WHEN f.gone THEN 'discarded' WHEN o.key_bytes = 0 THEN 'empty_key' WHEN o.key_bytes > {transactions.MOST_KEY} THEN 'key_too_long'
WHEN f.n + 1 >= {transactions.MOST_OPS} OR f.bytes + o.size >= {transactions.MOST_BYTES} THEN 'too_big' ELSE 'ok' END AS outcome FROM f JOIN o ON o.txn = f.txn AND o.r = f.r + 1))
SELECT txn, seq, outcome FROM f WHERE op = 'set'""")
def txn_validate(spark, sf_dir):
    return transactions.validated(_ops(spark, sf_dir))


READS = "ops AS (SELECT l_orderkey AS txn, CAST(l_linenumber AS BIGINT) AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'get' ELSE 'set' END AS op, l_orderkey % 9 = 0 AS read_only, l_partkey % 4 AS key FROM lineitem)"


@query(f"WITH {READS} SELECT DISTINCT txn, key FROM ops g WHERE op = 'get' AND NOT read_only AND NOT EXISTS (SELECT 1 FROM ops w WHERE w.txn = g.txn AND w.key = g.key AND w.op = 'set' AND w.seq <= g.seq)")
def txn_tracked_reads(spark, sf_dir):
    ops = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as txn", "cast(l_linenumber as bigint) as seq", "case when l_linenumber % 2 = 1 then 'get' else 'set' end as op", "l_orderkey % 9 = 0 as read_only", "l_partkey % 4 as key")
    return transactions.tracked_reads(ops)


FOLD = f"""{TXN}, e AS ({EDGE_SQL}), deps AS (SELECT txn, list(other) AS d FROM e GROUP BY txn), seqs AS (SELECT t.txn, t.shard, t.b // 2 AS r, coalesce(d, []) AS d FROM t LEFT JOIN deps USING (txn)),
f AS (SELECT shard, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS txn, CAST([] AS BIGINT[]) AS done, '' AS outcome FROM (SELECT DISTINCT shard FROM seqs) UNION ALL
SELECT f.shard, f.r + 1, s.txn, CASE WHEN list_has_any(f.done, s.d) THEN f.done ELSE list_append(f.done, s.txn) END, CASE WHEN list_has_any(f.done, s.d) THEN 'conflict' ELSE 'committed' END FROM f JOIN seqs s ON s.shard = f.shard AND s.r = f.r + 1)"""


@query(f"WITH RECURSIVE {FOLD} SELECT txn, outcome FROM f WHERE r > 0")
def txn_commit_outcome(spark, sf_dir):
    checkpoints(spark)
    txns, edges = _edges(spark, sf_dir)
    return transactions.outcomes(txns, edges, lambda d: d.checkpoint())


@query(f"WITH RECURSIVE {FOLD} SELECT txn, CAST(len(done) AS BIGINT) AS commit_ts FROM f WHERE outcome = 'committed'")
def txn_commit_ts(spark, sf_dir):
    return transactions.commit_numbers(txn_commit_outcome(spark, sf_dir), transactions.schedule(table(spark, sf_dir, "orders")))


@query(f"WITH {TXN}, live AS (SELECT shard, min(b) AS oldest FROM t WHERE txn % 50 = 0 GROUP BY shard) SELECT t.shard, t.txn FROM t LEFT JOIN live USING (shard) WHERE oldest IS NULL OR c <= oldest")
def txn_forgotten(spark, sf_dir):
    txns = transactions.schedule(table(spark, sf_dir, "orders"))
    return transactions.forgotten(txns, txns.where("txn % 50 = 0"))


@query(f"""WITH {TXN}, s AS (SELECT shard, b // 2 AS idx, c + txn % 7 * 10 AS done_at FROM t), p AS (SELECT shard, idx, max(done_at) OVER (PARTITION BY shard ORDER BY idx) AS at FROM s)
SELECT DISTINCT s.shard, s.done_at AS at, coalesce((SELECT max(p.idx) FROM p WHERE p.shard = s.shard AND p.at <= s.done_at), 0) AS done_until FROM s""")
def watermark_progress(spark, sf_dir):
    txns = transactions.schedule(table(spark, sf_dir, "orders"))
    return transactions.watermark(txns.select("shard", F.expr("begin div 2").alias("idx"), (F.col("commit") + F.col("txn") % 7 * 10).alias("done_at")))


@query("""WITH f AS (SELECT unnest([0.5, 0.1, 0.01, 0.001, 0.0001]) AS fp), n AS (SELECT count(*) AS keys FROM customer), b AS (SELECT fp, keys, CAST(ceil(-ln(fp) / (0.69314718056 * 0.69314718056)) AS BIGINT) AS bits_per_key FROM f, n)
SELECT fp, keys, bits_per_key, CAST(least(30, greatest(1, floor(bits_per_key * 0.69))) AS BIGINT) AS probes, CAST((greatest(64, keys * bits_per_key) + 7) // 8 AS BIGINT) AS bytes FROM b""")
def bloom_size(spark, sf_dir):
    return sketches.bloom_size(table(spark, sf_dir, "customer"), [0.5, 0.1, 0.01, 0.001, 0.0001])


@query(f"WITH s AS ({CMS_SQL}), c AS (SELECT row, slot, least(count(*), {sketches.CEILING}) AS c FROM s GROUP BY 1, 2) SELECT row, slot, CAST(c // 2 AS BIGINT) AS c FROM c WHERE c // 2 > 0")
def cms_halved(spark, sf_dir):
    return cache.halved(sketches.counters(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))))


@query()
def cache_hit_rate(spark, sf_dir):
    """A simulation in order of the trace: tested against a plain LRU's bounds and on small traces."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("trace"), F.col("event_id").alias("at"), F.col("user_id").cast("long").alias("key"))
    sizes = F.explode(F.array(*[F.lit(n) for n in (10, 50, 200)]))
    return cache.hit_rates(events.withColumn("capacity", sizes))


@query(f"""WITH {VLOG}, pick AS (SELECT fid FROM (SELECT fid, sum(len) AS size, sum(CASE WHEN key IN (SELECT key FROM live) THEN 0 ELSE len END) AS lost FROM vlog GROUP BY fid) WHERE lost * 100 >= size AND fid < (SELECT max(fid) FROM vlog) ORDER BY lost DESC, fid LIMIT 1),
m AS (SELECT v.* FROM vlog v WHERE fid = (SELECT fid FROM pick) AND key IN (SELECT key FROM live)), top AS (SELECT max(fid) + 1 AS fid FROM vlog)
SELECT key, (SELECT fid FROM top) AS fid, CAST(sum(len) OVER (ORDER BY off) AS BIGINT) - len AS "offset", len, fid AS old_fid, off AS old_offset FROM m""")
def vlog_gc_rewrite(spark, sf_dir):
    from .catalogue import vlog_layout, vlog_pick

    return values.rewritten(vlog_layout(spark, sf_dir), vlog_pick(spark, sf_dir), _live(spark, sf_dir))


@query(f"WITH {CHANGES} SELECT fid % 7 AS level, count(*) AS n_files FROM live GROUP BY 1")
def manifest_levels(spark, sf_dir):
    return metadata.live_files(_changes(spark, sf_dir)).groupBy((F.col("fid") % 7).alias("level")).agg(F.count("*").alias("n_files"))


@query("WITH c AS (SELECT (SELECT count(*) FROM orders) AS created, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS deleted) SELECT created, deleted, deleted > 100 AND deleted > 10 * (created - deleted) AS due FROM c")
def manifest_rewrite_due(spark, sf_dir):
    return metadata.rewrite_due(_changes(spark, sf_dir), 100, 10)


@query(f"WITH {CHANGES} SELECT fid, 'CREATE' AS op, seq FROM live")
def manifest_compacted(spark, sf_dir):
    return metadata.compacted(_changes(spark, sf_dir))


@query(f"WITH {LOG}, {FILES}, bad AS (SELECT * FROM (SELECT version // 100 AS fid, CAST(sum(length(key) + length(value) + 8) AS BIGINT) AS stale FROM log WHERE meta = 1 GROUP BY 1)) SELECT level, CAST(sum(size) AS BIGINT) AS size, CAST(sum(coalesce(stale, 0)) AS BIGINT) AS stale FROM files LEFT JOIN bad USING (fid) GROUP BY level")
def level_stale(spark, sf_dir):
    return retention.stale_by_level(kv_log(spark, sf_dir), _files(spark, sf_dir))


@query(_judged_sql(2, "false").replace("version <= ts AS old", "true AS old") + " SELECT key, version, value, meta, expires_at FROM j WHERE keep")
def store_roundtrip(spark, sf_dir):
    """The log appended in three batches, one of them twice, compacted, and read by a store opened anew."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    log, store = kv_log(spark, sf_dir), Store(spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}")
    for batch in (0, 1, 1, 2):
        store.append(log.where(F.col("version") % 3 == batch), batch)
    store.compact(2**62, 2, NOW)
    return Store(spark, store.path).rows()


assert str(NOW) == NOW_SQL
