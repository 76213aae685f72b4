"""All named queries over the log and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata, reads, retention, sketches, transactions, values
from ..sources.views import dead, kv_log, order_files, read_ts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_SQL = "1705708800"
LOG = f"""log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id + 1 AS version, props AS value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS meta,
  CASE WHEN event_type = 'signup' THEN epoch_us(ts) // 1000000 + 604800 ELSE 0 END AS expires_at FROM events),
point AS (SELECT max(version) * 8 // 10 AS ts FROM log),
d AS (SELECT *, (meta & 1) <> 0 OR (expires_at <> 0 AND expires_at <= {NOW_SQL}) AS dead FROM log)"""
NEWEST = LOG + ", newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM d, point WHERE version <= ts) WHERE r = 1), snap AS (SELECT key, version, value FROM newest WHERE NOT dead)"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _snapshot(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return reads.snapshot(log, read_ts(log))


@query(f"WITH {NEWEST} SELECT key, version, value FROM snap")
def snapshot_read(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return reads.snapshot_by_rank(log, read_ts(log))


@query(f"WITH {LOG}, m AS (SELECT key, max(version) AS version FROM d, point WHERE version <= ts GROUP BY key) SELECT key, version, value FROM d JOIN m USING (key, version) WHERE NOT dead")
def snapshot_read_maxby(spark, sf_dir):
    return _snapshot(spark, sf_dir)


@query(f"WITH {NEWEST} SELECT key, version, value FROM snap WHERE key IN ('7', '42', '99')")
def point_get(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return reads.snapshot(log.where("key in ('7', '42', '99')"), read_ts(log))


@query(f"""WITH {LOG}, probes AS (SELECT o_orderkey AS id, CAST(o_custkey % 200 AS VARCHAR) AS key, o_orderkey % (SELECT max(version) FROM log) + 1 AS ts FROM orders)
SELECT p.id, p.key, p.ts, d.version, d.value FROM probes p ASOF JOIN d ON p.key = d.key AND p.ts >= d.version WHERE NOT d.dead""")
def multi_asof_get(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    top = log.agg(F.max("version")).first()[0] or 1
    probes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).cast("string").alias("key"), (F.col("o_orderkey") % top + 1).alias("ts"))
    return reads.asof(probes, log)


@query(f"WITH {LOG} SELECT key, count(*) AS n_versions, max(version) AS newest FROM log, point WHERE version <= ts GROUP BY key")
def visible_versions(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return log.where(F.col("version") <= read_ts(log)).groupBy("key").agg(F.count("*").alias("n_versions"), F.max("version").alias("newest"))


@query(f"WITH {NEWEST} SELECT key, version, value FROM snap WHERE key >= '20' AND key < '60' ORDER BY key")
def scan_snapshot_range(spark, sf_dir):
    return _snapshot(spark, sf_dir).where("key >= '20' and key < '60'").orderBy("key")


@query(f"WITH {NEWEST} SELECT key, version, value FROM snap ORDER BY key DESC LIMIT 20")
def scan_desc_limit(spark, sf_dir):
    return _snapshot(spark, sf_dir).orderBy(F.desc("key")).limit(20)


@query(f"WITH {NEWEST} SELECT key, version, value FROM snap WHERE starts_with(key, '1') ORDER BY key")
def prefix_scan(spark, sf_dir):
    return _snapshot(spark, sf_dir).where(F.col("key").startswith("1")).orderBy("key")


SEEKS = ["", "0", "10b", "42", "500", "99", "z"]


@query(f"WITH {LOG}, p AS (SELECT unnest({SEEKS}) AS probe) SELECT probe, (SELECT min(key) FROM log WHERE key >= probe) AS at_or_after, (SELECT max(key) FROM log WHERE key <= probe) AS at_or_before FROM p")
def seek(spark, sf_dir):
    return reads.seek(kv_log(spark, sf_dir), SEEKS)


@query(f"WITH {LOG} SELECT key, version, CASE WHEN version % 3 = 0 THEN upper(value) ELSE value END AS value, meta, expires_at FROM log")
def merge_runs(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    newer = log.where("version % 3 = 0").withColumn("value", F.upper("value"))
    return reads.merge_runs(newer, log)


@query(f"WITH {LOG} SELECT key, version, upper(hex(encode(key))) || upper(lpad(format('{{:x}}', CAST(18446744073709551615 - version AS UBIGINT)), 16, '0')) AS internal_key FROM log")
def key_codec(spark, sf_dir):
    return kv_log(spark, sf_dir).select("key", "version", F.concat(F.hex(F.encode("key", "utf-8")), F.lpad(F.hex(F.bitwise_not("version")), 16, "0")).alias("internal_key"))


@query(f"""WITH {NEWEST}, own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM log, point WHERE version > ts AND version <= ts + 50) WHERE r = 1)
SELECT key, value, false AS own FROM snap WHERE key NOT IN (SELECT key FROM own) UNION ALL SELECT key, value, true FROM own WHERE meta = 0""")
def read_your_writes(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    ts = read_ts(log)
    return reads.overlay(reads.snapshot(log, ts), log.where((F.col("version") > ts) & (F.col("version") <= ts + 50)))


@query(f"WITH {LOG} SELECT key, version, expires_at FROM log WHERE expires_at = 0 OR expires_at > {NOW_SQL}")
def ttl_live(spark, sf_dir):
    return kv_log(spark, sf_dir).where(f"expires_at = 0 or expires_at > {NOW_SQL}").select("key", "version", "expires_at")


@query(f"WITH {LOG} SELECT key, version, expires_at FROM log WHERE expires_at <> 0 AND expires_at <= {NOW_SQL}")
def ttl_expired(spark, sf_dir):
    return kv_log(spark, sf_dir).where(f"expires_at <> 0 and expires_at <= {NOW_SQL}").select("key", "version", "expires_at")


@query(f"WITH {LOG} SELECT max(version) AS max_version, count(*) AS n_rows, CAST(sum(CASE WHEN dead THEN 1 ELSE 0 END) AS BIGINT) AS n_dead FROM d")
def max_version(spark, sf_dir):
    return kv_log(spark, sf_dir).agg(F.max("version").alias("max_version"), F.count("*").alias("n_rows"), F.sum(dead().cast("long")).alias("n_dead"))


RUN_SQL = "SELECT version // 500 AS fid, count(*) AS key_count, max(version) AS max_version, min(key) AS min_key, max(key) AS max_key, CAST(sum(length(key) + length(value) + 8) AS BIGINT) AS size FROM log GROUP BY 1"


@query(f"WITH {LOG} {RUN_SQL}")
def run_stats(spark, sf_dir):
    return retention.run_stats(kv_log(spark, sf_dir))


@query(f"WITH {LOG}, runs AS ({RUN_SQL}) SELECT least(fid // 4, 6) AS level, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size FROM runs GROUP BY 1")
def level_stats(spark, sf_dir):
    return retention.run_stats(kv_log(spark, sf_dir)).groupBy(F.expr("least(fid div 4, 6)").alias("level")).agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))


def _judged_sql(n: int, overlap: str) -> str:
    return f"""WITH {LOG}, o AS (SELECT *, version <= ts AS old FROM d, point), w AS (SELECT *, sum(CASE WHEN old THEN 1 ELSE 0 END) OVER k AS pos,
  coalesce(sum(CASE WHEN old AND dead THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY version DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM o WINDOW k AS (PARTITION BY key ORDER BY version DESC)),
j AS (SELECT *, NOT old OR (pos <= {n} AND prior = 0 AND (NOT dead OR {overlap})) AS keep FROM w)"""


def _compact(n: int, overlap: bool):
    def run(spark, sf_dir):
        log = kv_log(spark, sf_dir)
        return retention.compact(log, read_ts(log), n, overlap)

    return run


for _name, _n, _overlap in (("compact_n1", 1, False), ("compact_n2", 2, False), ("compact_n1_overlap", 1, True), ("compact_n3_overlap", 3, True)):
    QUERIES[_name] = _compact(_n, _overlap)
    ORACLE_SQL[_name] = _judged_sql(_n, str(_overlap).lower()) + " SELECT key, version, value, meta, expires_at FROM j WHERE keep"


@query(_judged_sql(1, "false") + " SELECT version // 500 AS fid, CAST(sum(length(value)) AS BIGINT) AS discard FROM j WHERE NOT keep GROUP BY 1")
def discard_stats(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return retention.judged(log, read_ts(log), 1, False).where("not keep").groupBy(F.expr("version div 500").alias("fid")).agg(F.sum(F.length("value")).cast("long").alias("discard"))


def _files_sql(name: str, width: int) -> str:
    return f"{name} AS (SELECT o_orderkey // {width} AS fid, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders GROUP BY 1)"


@query(f"WITH {_files_sql('a', 1000)}, {_files_sql('b', 1700)} SELECT a.fid AS a_fid, b.fid AS b_fid FROM a JOIN b ON a.min_key <= b.max_key AND a.max_key >= b.min_key")
def file_overlap(spark, sf_dir):
    return retention.overlaps(order_files(spark, sf_dir, 1000), order_files(spark, sf_dir, 1700))


@query(f"WITH {_files_sql('a', 1000)}, i AS (SELECT *, row_number() OVER (ORDER BY min_key) - 1 AS i, count(*) OVER () AS n FROM a), w AS (SELECT *, greatest(3, (n + 4) // 5) AS width FROM i) SELECT fid, max_key AS boundary FROM w WHERE i % width = width - 1 OR i = n - 1")
def split_ranges(spark, sf_dir):
    return retention.split_ranges(order_files(spark, sf_dir, 1000))


VLOG = """l AS (SELECT doc_id AS key, text AS value, strlen(text) + length(CAST(doc_id AS VARCHAR)) + 21 AS len FROM documents WHERE strlen(text) >= 1024),
p AS (SELECT *, CAST(sum(len) OVER (ORDER BY key) AS BIGINT) - len AS begins FROM l), vlog AS (SELECT key, begins // 1048576 AS fid, begins % 1048576 AS off, len, value FROM p),
live AS (SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _live(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("key"))


@query(f'WITH {VLOG} SELECT key, fid, off AS "offset", len FROM vlog')
def vlog_layout(spark, sf_dir):
    return values.placed(_docs(spark, sf_dir))


@query("SELECT doc_id AS key, md5(text) AS value_md5 FROM documents")
def vlog_deref(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return values.deref(values.index(docs, values.placed(docs)), values.layout(docs)).select("key", F.md5("value").alias("value_md5"))


@query(f'WITH {VLOG} SELECT key, fid, off AS "offset", len FROM vlog WHERE key IN (SELECT key FROM live)')
def vlog_gc_live(spark, sf_dir):
    return vlog_layout(spark, sf_dir).join(_live(spark, sf_dir), "key", "left_semi")


@query(f'WITH {VLOG} SELECT key, fid, off AS "offset", len FROM vlog WHERE key NOT IN (SELECT key FROM live)')
def vlog_gc_dead(spark, sf_dir):
    return values.garbage(vlog_layout(spark, sf_dir), _live(spark, sf_dir))


RATIO_SQL = f"WITH {VLOG}, r AS (SELECT fid, CAST(sum(len) AS BIGINT) AS size, CAST(sum(CASE WHEN key IN (SELECT key FROM live) THEN 0 ELSE len END) AS BIGINT) AS discard FROM vlog GROUP BY fid)"


@query(f"{RATIO_SQL} SELECT fid, size, discard FROM r")
def vlog_discard_ratio(spark, sf_dir):
    return values.discard_ratio(vlog_layout(spark, sf_dir), _live(spark, sf_dir))


@query(f"{RATIO_SQL} SELECT fid, size, discard FROM r WHERE discard * 100 >= size AND fid < (SELECT max(fid) FROM r) ORDER BY discard DESC, fid LIMIT 1")
def vlog_pick(spark, sf_dir):
    ratio = vlog_discard_ratio(spark, sf_dir)
    active = ratio.agg(F.max("fid").alias("_active"))
    return ratio.join(F.broadcast(active), F.col("fid") < F.col("_active")).where("discard * 100 >= size").orderBy(F.desc("discard"), "fid").limit(1).select("fid", "size", "discard")


CHANGES = """changes AS (SELECT o_orderkey AS fid, o_orderkey * 16 AS seq, 'CREATE' AS op FROM orders UNION ALL SELECT l_orderkey, l_orderkey * 16 + l_linenumber, 'DELETE' FROM lineitem WHERE l_returnflag = 'R'),
last AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY seq DESC) AS r, lag(op, 1, 'DELETE') OVER (PARTITION BY fid ORDER BY seq) AS before FROM changes), live AS (SELECT fid, seq FROM last WHERE r = 1 AND op = 'CREATE')"""


def _changes(spark, sf_dir):
    created = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid"), (F.col("o_orderkey") * 16).alias("seq"), F.lit("CREATE").alias("op"))
    deleted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fid"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), F.lit("DELETE").alias("op"))
    return created.union(deleted)


@query(f"WITH {CHANGES} SELECT fid, seq FROM live")
def manifest_live(spark, sf_dir):
    return metadata.live_files(_changes(spark, sf_dir))


@query(f"WITH {CHANGES} SELECT fid, seq, op FROM last WHERE op = before")
def manifest_violations(spark, sf_dir):
    return metadata.violations(_changes(spark, sf_dir))


@query(f"WITH {CHANGES}, found AS (SELECT o_orderkey AS fid FROM orders WHERE o_orderstatus <> 'F') SELECT fid, 'missing' AS kind FROM live WHERE fid NOT IN (SELECT fid FROM found) UNION ALL SELECT fid, 'orphan' FROM found WHERE fid NOT IN (SELECT fid FROM live)")
def manifest_orphans(spark, sf_dir):
    found = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("fid"))
    return metadata.differences(metadata.live_files(_changes(spark, sf_dir)), found)


WAL = "wal AS (SELECT event_id AS pos, event_id // 4 AS ts, CASE event_type WHEN 'purchase' THEN 'fin' WHEN 'click' THEN 'txn' WHEN 'view' THEN 'txn' ELSE 'plain' END AS kind, user_id % 37 <> 0 OR event_type <> 'error' OR event_id < 100 AS crc_ok FROM events)"


def _wal(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "fin").when(F.col("event_type").isin("click", "view"), "txn").otherwise("plain")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.expr("event_id div 4").alias("ts"), kind.alias("kind"), F.expr("user_id % 37 <> 0 or event_type <> 'error' or event_id < 100").alias("crc_ok"))


@query(f"WITH {WAL} SELECT pos, ts FROM wal WHERE kind = 'plain' OR (kind = 'txn' AND ts IN (SELECT ts FROM wal WHERE kind = 'fin'))")
def wal_replay(spark, sf_dir):
    return metadata.replay(_wal(spark, sf_dir))


@query(f"WITH {WAL} SELECT pos FROM wal WHERE pos < coalesce((SELECT min(pos) FROM wal WHERE NOT crc_ok), 9223372036854775807)")
def wal_bad_tail(spark, sf_dir):
    return metadata.valid_prefix(_wal(spark, sf_dir))


@query("SELECT l_orderkey AS txn, l_partkey % 10 AS key, CAST(max(l_linenumber) AS BIGINT) AS seq, max_by(l_quantity, l_linenumber * 1000 + l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def txn_last_write(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txn"), (F.col("l_partkey") % 10).alias("key")).agg(F.max("l_linenumber").cast("long").alias("seq"), F.max_by("l_quantity", F.struct("l_linenumber", "l_quantity")).alias("value"))


TXN = """o AS (SELECT o_orderkey AS txn, o_custkey % 16 AS shard, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderdate, o_orderkey) AS rn FROM orders), t AS (SELECT txn, shard, 2 * rn AS b, 2 * rn + 17 AS c FROM o),
rd AS (SELECT t.*, l_partkey AS key FROM lineitem JOIN t ON txn = l_orderkey WHERE l_linenumber % 2 = 1), wr AS (SELECT t.*, l_partkey AS key FROM lineitem JOIN t ON txn = l_orderkey WHERE l_linenumber % 2 = 0)"""


def _edges(spark, sf_dir):
    txns = transactions.schedule(table(spark, sf_dir, "orders"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), F.col("l_partkey").alias("key"), "l_linenumber")
    side = lambda odd: lines.where(f"l_linenumber % 2 = {odd}").drop("l_linenumber")
    return txns, transactions.conflict_edges(txns, side(1), side(0))


@query(f'WITH {TXN} SELECT txn, shard, b AS "begin", c AS "commit" FROM t')
def txn_schedule(spark, sf_dir):
    return transactions.schedule(table(spark, sf_dir, "orders"))


EDGE_SQL = "SELECT DISTINCT rd.txn AS txn, wr.txn AS other FROM rd JOIN wr ON rd.shard = wr.shard AND rd.key = wr.key AND rd.txn <> wr.txn AND rd.b < wr.c AND wr.c < rd.c"


@query(f"WITH {TXN} {EDGE_SQL}")
def txn_conflict_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1]


def checkpoints(spark):
    """The shared folder that the cluster names; only where it is unset one under the warehouse."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


BITS_SQL = "pos AS (SELECT k, ((k * 40503) % 1000003 + i * ((k * 30011) % 65521 + 1)) % 16384 AS bit FROM {0}, (SELECT unnest(range(7)) AS i))"
CUSTOMERS = "keys AS (SELECT c_custkey AS k FROM customer)"


@query(f"WITH {CUSTOMERS}, {BITS_SQL.format('keys')} SELECT bit, count(*) AS n_set FROM pos GROUP BY bit")
def bloom_bits(spark, sf_dir):
    return sketches.bloom_bits(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query(f"WITH {CUSTOMERS}, bits AS (SELECT DISTINCT bit FROM (WITH {BITS_SQL.format('keys')} SELECT bit FROM pos)), parts AS (SELECT p_partkey * 3 AS k FROM part), {BITS_SQL.format('parts')} SELECT k AS key, CAST(min(CASE WHEN bit IN (SELECT bit FROM bits) THEN 1 ELSE 0 END) AS INTEGER) AS maybe FROM pos GROUP BY k")
def bloom_probe(spark, sf_dir):
    return sketches.bloom_probe(table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("key")), bloom_bits(spark, sf_dir))


CMS_SQL = "UNION ALL ".join(f"SELECT user_id AS key, {i} AS row, (user_id * {m} + {i}) % 1000003 % {sketches.WIDTH} AS slot FROM events " for i, m in enumerate(sketches.MULTIPLIERS))


@query(f"WITH s AS ({CMS_SQL}), c AS (SELECT row, slot, least(count(*), {sketches.CEILING}) AS c FROM s GROUP BY 1, 2) SELECT key, CAST(min(c) AS BIGINT) AS estimate FROM (SELECT DISTINCT * FROM s) JOIN c USING (row, slot) GROUP BY key")
def cms_estimate(spark, sf_dir):
    return sketches.count_min(table(spark, sf_dir, "events").select(F.col("user_id").alias("key")))


@query(f"""WITH k AS (SELECT c_custkey // {sketches.BLOCK} AS block, c_name AS key FROM customer), b AS (SELECT *, min(key) OVER (PARTITION BY block) AS base FROM k),
p AS (SELECT *, CASE WHEN key = base THEN 0 ELSE len(list_filter(range(1, length(key) + 1), lambda i: key[1:i] = base[1:i])) END AS shared FROM b)
SELECT block, count(*) AS n_keys, CAST(sum(length(key)) AS BIGINT) AS bytes, CAST(sum(shared) AS BIGINT) AS saved FROM p GROUP BY block""")
def prefix_compression(spark, sf_dir):
    return sketches.prefix_compression(table(spark, sf_dir, "customer").select(F.expr(f"c_custkey div {sketches.BLOCK}").alias("block"), F.col("c_name").alias("key")))
