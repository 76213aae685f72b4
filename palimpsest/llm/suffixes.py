"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A string of LENGTH bytes is known by its anchor, the leftmost smallest hash of its GRAM-byte grams. Equal strings have equal
anchors at equal places in them, so they meet under the anchor's hash. The starts of a text that share one anchor occurrence form
a run of about 40; a run stands for its starts, and only runs whose anchor occurs again are looked at further:

1. Runs of equal bytes are aggregated; all but the first are repeats as a whole, and only the first goes on.
2. First runs of an anchor with different surroundings are dealt to tasks by their anchor, with their bytes. A task
   feeds them in order of document and place, in batches, to a LevelIndex: each batch gets a suffix array, is merge-scanned
   against the levels for strings that were there before, and levels of equal size are merged.
   Runs of an anchor that is too frequent for one task are cut into blocks of starts by their distance to the anchor, each
   dealt by a hash of the bytes that all its strings have.

No task sees more than a share of the runs, and what is kept of a group of copies is one row a run and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, stored, table, trimmed

LENGTH, GRAM = 100, 24
#: Grams of a string, and bytes of text whose runs are found at once (places take 20 bits beside the hash).
GRAMS, CHUNK = LENGTH - GRAM + 1, 1 << 19
#: Starts a task is dealt on average, starts of a batch, runs of an anchor beyond which they are dealt in blocks, and starts of a block.
TASK_STARTS, BATCH_STARTS, HOT_RUNS, BLOCK = 300_000, 20_000, 1_000, 16
#: A key that more than this share of the rows have is joined by broadcast; there are fewer such keys than this number.
HEAVY = 4096
NO_ID = 2**63 - 1
RUNS = "d long, uid long, a long, n int, anchor long, bytes_hash long"


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every GRAM-byte gram, from hashes of 8 and 16 bytes."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    have, parts = 1, {}
    for step in (1, 2, 4, 8):
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        have += step
        parts[have] = h
    g = parts[16][: len(b) - GRAM + 1] * np.uint64(0x94D049BB133111EB) + parts[8][16:]
    return (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of starts and anchors of the runs of a text: they cover each start of a LENGTH-byte string once."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + LENGTH - 1, len(data) - at), at)
        g = _gram_hashes(b)
        least = (g >> np.uint64(20) << np.uint64(20)) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(g) - GRAMS + 1], least[GRAMS - width :])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        found.append((first + at, np.diff(np.r_[first, len(least)]), (least[first] >> np.uint64(20)).astype(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    h = xxhash.xxh64_intdigest
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], []]
        held = 0
        for d, uid, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = text.encode()
            a, n, anchor = runs(data)
            whole = np.array([h(data[s:e]) for s, e in zip(a.tolist(), (a + n + LENGTH - 1).tolist(), strict=True)], np.uint64).view(np.int64)
            for c, v in zip(cols, (np.full(len(a), d, np.int64), np.full(len(a), uid, np.int64), a, n.astype(np.int32), anchor, whole), strict=True):
                c.append(v)
            held += len(a)
            if held > 200_000:
                yield _batch(cols)
                cols, held = [[], [], [], [], [], []], 0
        if held:
            yield _batch(cols)


def _batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=[x.split()[0] for x in RUNS.split(", ")])


class LevelIndex:
    """Sorted arrays of distinct LENGTH-byte strings, each level at least twice as large as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, strings: np.ndarray) -> np.ndarray:
        """Which of the strings, in their order, were added before, in this batch or an earlier one."""
        order = np.argsort(strings, kind="stable")  # the batch's suffix array, to the depth that matters
        sorted_ = strings[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(order) else np.zeros(0, bool)
        seen = np.ones(len(strings), bool)
        for level in self.levels:  # merge-scan
            at = np.minimum(np.searchsorted(level, sorted_), len(level) - 1)
            new &= level[at] != sorted_
        seen[order[new]] = False
        if new.any():
            self.levels.append(sorted_[new])
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            small, large = self.levels.pop(), self.levels.pop()
            self.levels.append(np.insert(large, np.searchsorted(large, small), small))
        return seen


def strings_at(data: bytes, n: int) -> np.ndarray:
    """The strings at the first n starts of data, as fixed-width values; a last byte keeps trailing zero bytes significant."""
    out = np.ones((n, LENGTH + 1), np.uint8)
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LENGTH)[:n]
    return out.reshape(-1).view(f"S{LENGTH + 1}")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, a, n, bytes) in order; gives (uid, a, n) of stretches of starts that are repeats."""
    index = LevelIndex()

    def flush(rows):
        if not rows:
            return None
        seen = index.add(np.concatenate([strings_at(b, n) for _, _, n, b in rows]))
        out, at = [], 0
        for uid, a, n, _ in rows:
            mask = np.r_[0, seen[at : at + n].astype(np.int8), 0]
            step = np.diff(mask)
            out += [(uid, a + s, e - s) for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
            at += n
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())], names=["uid", "a", "n"])

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rows.append(row)
            held += row[2]
            if held >= BATCH_STARTS:
                yield flush(rows)
                rows, held = [], 0
    if rows:
        yield flush(rows)


def blocks(piece: bytes, n: int) -> list[tuple[int, int, int]]:
    """Key, first start and number of starts of the blocks of a run of n starts. Equal strings have equal anchors at equal distances
    from their starts, so they lie in blocks of one number, and the bytes that all strings of such a block have are equal too."""
    import xxhash

    anchor = n - 1 + int(np.argmin(_gram_hashes(np.frombuffer(piece, np.uint8))[n - 1 : GRAMS] >> np.uint64(20)))
    out = []
    for j in range((anchor - n + 1) // BLOCK, anchor // BLOCK + 1):
        last = anchor - j * BLOCK
        low, high = max(0, last - BLOCK + 1), min(n - 1, last)
        out.append((xxhash.xxh64_intdigest(piece[last : last + LENGTH - BLOCK + 1], j) >> 1, low, high - low + 1))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of a document's runs, dealt by anchor; those of hot anchors in blocks."""

    def out(rows):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["deal", "d", "uid", "a", "n", "bytes"])

    for batch in batches:
        rows = []
        for uid, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = text.encode()
            for r in found:
                d, a, n = r["d"], r["a"], r["n"]
                if r["hot"]:
                    rows += [(key, d, uid, a + s, m, data[a + s : a + s + m + LENGTH - 1]) for key, s, m in blocks(data[a : a + n + LENGTH - 1], n)]
                else:
                    rows.append((r["anchor"], d, uid, a, n, data[a : a + n + LENGTH - 1]))
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """rows.join(keys, on) for stored keys that are distinct on `on`, where `times` counts the rows of rows (`total` in all) with each key.

    Keys that more than total / HEAVY rows have are fewer than HEAVY, whatever the data: these are broadcast and their rows stay
    where they are. Every other key has at most that many rows, so no task of the shuffle that is left gets a large group.
    """
    heavy = F.col(times) * HEAVY > total
    hot = F.broadcast(keys.where(heavy))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(keys.where(~heavy), on))


def repeats(docs: DataFrame) -> DataFrame:
    """(uid, a, n): stretches of starts of LENGTH-byte strings that also start earlier. docs: d, uid, text."""
    spark = docs.sparkSession
    found, found_at = stored(docs.select("d", "uid", "text").mapInArrow(lambda b: trimmed(_find_runs(b)), RUNS), "runs")
    total = found.count()
    anchors = found.groupBy("anchor").agg(F.count("*").alias("_c"), F.min("bytes_hash").alias("_lo"), F.max("bytes_hash").alias("_hi")).where("_c > 1")
    keys, keys_at = stored(anchors.select("anchor", "_c", (F.col("_lo") != F.col("_hi")).alias("varied")), "anchors")
    again, again_at = stored(join_counted(found, keys, ["anchor"], "_c", total).select(*found.columns, "varied"), "again")
    discard(spark, found_at, keys_at)
    first, first_at = stored(again.groupBy("anchor", "bytes_hash").agg(F.min(F.struct("d", "uid", "a", "n")).alias("f"), F.max("varied").alias("varied"), F.count("*").alias("_c")), "first")
    copied = first.where("_c > 1").select("anchor", "bytes_hash", "f", "_c")
    copies = join_counted(again, copied, ["anchor", "bytes_hash"], "_c", total).where((F.col("uid") != F.col("f.uid")) | (F.col("a") != F.col("f.a"))).select("uid", "a", "n")
    varied = first.where("varied").select("anchor", "f.*")
    sizes, sizes_at = stored(varied.groupBy("anchor").agg(F.count("*").alias("_runs"), F.sum("n").alias("_starts")), "sizes")
    starts, different = (x or 0 for x in sizes.agg(F.sum("_starts"), F.sum("_runs")).first())
    by_doc = join_counted(varied, sizes, ["anchor"], "_runs", different).groupBy("uid").agg(F.collect_list(F.struct("d", "a", "n", "anchor", (F.col("_runs") > HOT_RUNS).alias("hot"))).alias("runs"))
    dealt = docs.select("uid", "text").join(by_doc, "uid").select("uid", "text", "runs").mapInArrow(lambda b: trimmed(_pieces(b)), "deal long, d long, uid long, a long, n int, bytes binary")
    dealt = dealt.repartition(max(1, -(-starts // TASK_STARTS)), "deal").sortWithinPartitions("d", "uid", "a").select("uid", "a", "n", "bytes")
    out, _ = stored(copies.union(dealt.mapInArrow(lambda b: trimmed(_scan(b)), "uid long, a long, n int")), "repeats")
    discard(spark, again_at, first_at, sizes_at)
    return out


def spans(found: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes covered by strings at stretches (start, number of starts)."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(found):
        end = a + n + length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, uid, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data, at, kept = text.encode(), 0, []
            gone = spans([(x["a"], x["n"]) for x in found or []])
            for s, e in gone:
                kept.append(data[at:s])
                at = e
            rows.append((doc, uid, len(data), sum(e - s for s, e in gone), [{"start": s, "end": e} for s, e in gone], b"".join([*kept, data[at:]])))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "uid", "n_bytes", "n_removed", "spans", "kept"])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row (uid), written to the shared folder so that it stays."""
    return stored(docs.withColumn("uid", F.monotonically_increasing_id()), "rows")[0]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, uid, n_bytes, n_removed, spans and kept (the remaining bytes) per row of docs (doc_id, uid, text).

    Texts are UTF-8 bytes, null is empty. Every byte covered by a LENGTH-byte string that also starts earlier goes; earlier is a
    smaller doc_id, then a smaller uid, then an earlier place; a null doc_id comes last. Cuts may fall inside a character.
    """
    t = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "uid", F.coalesce("text", F.lit("")).alias("text"))
    by_row = repeats(t).groupBy("uid").agg(F.collect_list(F.struct("a", "n")).alias("found"))
    return t.join(by_row, "uid", "left").select("doc_id", "uid", "text", "found").mapInArrow(lambda b: trimmed(_apply(b)), "doc_id long, uid long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeats removed from their texts, all other columns as they were, whatever those are called. A row is
    dropped only if nothing of a text that had bytes is left. Bytes of characters that a cut has split are left out. Null and empty
    texts stay; of equal rows the first read keeps its text; a null doc_id comes last; an empty table stays empty."""
    uid, of, text = (fresh(docs, x) for x in ("uid", "of", "rest"))
    rows, _ = stored(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    done = remove_repeats(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(uid).alias("uid"), "text")).where("n_removed > 0").select("uid", "kept")
    fixed = done.mapInArrow(_decode, "uid long, text string").toDF(of, text)
    joined = rows.join(fixed, F.col(uid) == F.col(of), "left").where(F.col(of).isNull() | (F.col(text) != ""))
    return joined.select(*[F.coalesce(F.col(text), F.col(c)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.decode(errors="ignore") for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(texts, pa.string())], names=["uid", "text"])


def op1_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
