"""WARC archives with a two-level capture index.

Records are gzip members in part files of a shared folder. The index sorts the captures by reversed-host key, packs them into
compressed blocks and keeps a sparse directory with each block's first key. A look-up bisects the directory, reads the blocks
that can hold the key and then the byte range of each record; nothing else of an archive is read.

Files are written by tasks under names with the attempt's number and become visible through the rows that the task returns, so a
task that is run again leaves at worst a file to which nothing refers.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, scratch, table

LEAST_REVISIT, LINES_PER_BLOCK, DATE = 100, 1000, "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ENTRIES = "url_key string, page_id long, file string, offset long, length long"
BLOCKS = "shard int, first_key string, file string, offset long, length long, lines long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
CAPTURES = RECORDS + ", payload binary"


def url_key(url: str) -> str:
    """Host reversed by its labels, lower case, without scheme, user, port 80 or 443 and fragment: com,example,www)/path?query."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut_at = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut_at].rpartition("@")[2].lower(), rest[cut_at:] or "/"
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + path


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has no payload of its own but the full one's digest and length."""
    one_line = " ".join(url.split())
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest[:32]}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload's length and digest are held against the headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    payload = rest[:length]
    if len(payload) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload's digest is wrong")
    number = lambda s: int(s) if s else None
    page = number(fields["WARC-Record-ID"][10:-1].split(":")[0])
    refers = number(fields["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
    return {"page_id": page, "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=4, mtime=0)


def _attempt() -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId()}-{t.taskAttemptId()}"


def _rows(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def _write_records(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = _fs(folder)
    name, out, at = f"{_attempt()}.warc.gz", None, 0
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
                info = b"software: palimpsest\r\nformat: WARC File Format 1.0\r\n"
                at += out.write(_member(f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:file:{name}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
            n = out.write(_member(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["first"], r["revisit"])))
            rows.append({"url_key": url_key(r["url"]), "page_id": r["page_id"], "file": name, "offset": at, "length": n})
            at += n
        if rows:
            yield _rows(rows, ["url_key", "page_id", "file", "offset", "length"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])
    if out is not None:
        out.close()


def _write_blocks(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = _fs(folder)
    shard, name, out, at, lines, blocks = int(_attempt().split("-")[0]), f"{_attempt()}.cdx.gz", None, 0, [], []

    def flush() -> None:
        nonlocal out, at
        out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
        n = out.write(_member("".join(x + "\n" for _, x in lines).encode()))
        blocks.append({"shard": shard, "first_key": lines[0][0], "file": name, "offset": at, "length": n, "lines": len(lines)})
        at += n
        lines.clear()

    for batch in batches:
        for r in batch.to_pylist():
            lines.append((r["url_key"], json.dumps([r["url_key"], r["page_id"], r["file"], r["offset"], r["length"]], ensure_ascii=False)))
            if len(lines) == LINES_PER_BLOCK:
                flush()
    if lines:
        flush()
    if out is not None:
        out.close()
    if blocks:
        yield _rows(blocks, ["shard", "first_key", "file", "offset", "length", "lines"], [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])


class _Ranges:
    """Byte ranges of files of one folder; the file read last stays open."""

    def __init__(self, folder: str):
        (self.fs, self.base), self.name, self.file = _fs(folder), None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.base}/{name}")
        self.file.seek(offset)
        return zlib.decompress(self.file.read(length), wbits=31)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _entries(block: bytes) -> Iterator[dict]:
    for line in block.decode().splitlines():
        k, p, f, o, n = json.loads(line)
        yield {"url_key": k, "page_id": p, "file": f, "offset": o, "length": n}


ENTRY_COLUMNS = (["url_key", "page_id", "file", "offset", "length"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])
RECORD_COLUMNS = (["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()])


class _Merge:
    """Keys and directory entries of shards in order: a key can lie in the last block that begins before it and in those that begin
    with it. The entries of the block at hand are bisected; of earlier blocks only entries of the last key are remembered."""

    def __init__(self):
        self.shard, self.block, self.entries, self.key, self.found = None, None, None, None, []

    def take(self, r: dict, files: _Ranges) -> list[dict]:
        """Captures that a row of the order gives. Blocks that begin with a key come before it, after the block that ends before."""
        if r["shard"] != self.shard:
            self.shard, self.block, self.entries, self.key, self.found = r["shard"], None, None, None, []
        if not r["kind"]:
            if r["url_key"] != self.key:
                self.key, self.found = r["url_key"], self._in_block(r["url_key"], files)
            elif self.block is not None:
                self.found += self._in_block(r["url_key"], files)
            self.block, self.entries = r, None
            return []
        before = self.found if r["url_key"] == self.key else []
        return before + self._in_block(r["url_key"], files)

    def _in_block(self, key: str, files: _Ranges) -> list[dict]:
        if self.block is None:
            return []
        if self.entries is None:
            self.entries = list(_entries(files.read(self.block["file"], self.block["offset"], self.block["length"])))
        of = lambda e: e["url_key"]
        return self.entries[bisect.bisect_left(self.entries, key, key=of) : bisect.bisect_right(self.entries, key, key=of)]


@dataclass
class Archive:
    """A folder of WARC files and index blocks, and the directory of the blocks."""

    folder: str
    directory: DataFrame

    def entries(self) -> DataFrame:
        """All captures, from the index blocks."""
        folder = self.folder

        def run(batches):
            files = _Ranges(folder)
            for batch in batches:
                for r in batch.to_pylist():
                    yield _rows(list(_entries(files.read(r["file"], r["offset"], r["length"]))), *ENTRY_COLUMNS)
            files.close()

        blocks = self.directory.select("file", "offset", "length")
        return blocks.repartition(partitions(blocks.sparkSession), "file", "offset").mapInArrow(run, ENTRIES)

    def find(self, urls: DataFrame) -> DataFrame:
        """Captures of the distinct URLs of column `url`, with payloads (null for a revisit). Null URLs find nothing."""
        folder = self.folder
        firsts = [(r["shard"], r["k"]) for r in self.directory.groupBy("shard").agg(F.min("first_key").alias("k")).orderBy("shard").collect()]  # as many as index files

        def shards(batches):
            keys = [k for _, k in firsts]
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    k = url_key(r["url"])
                    low, high = max(0, bisect.bisect_left(keys, k) - 1), bisect.bisect_right(keys, k)
                    rows += [{"shard": s, "url_key": k} for s, _ in firsts[low:high]]
                yield _rows(rows, ["shard", "url_key"], [pa.int32(), pa.string()])

        wanted = urls.select("url").where("url is not null").distinct().mapInArrow(shards, "shard int, url_key string").distinct()
        # blocks of a shard and keys looked up in it, in one order: a block is read once, and stays while keys need it
        blocks = self.directory.select("shard", F.col("first_key").alias("url_key"), F.lit(0).alias("kind"), "file", "offset", "length")
        keys = wanted.select("shard", "url_key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"))
        both = blocks.union(keys).repartition(partitions(blocks.sparkSession), "shard").sortWithinPartitions("shard", "url_key", "kind", "offset")

        def pick(batches):
            files, merged = _Ranges(folder), _Merge()
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    rows += merged.take(r, files)
                yield _rows(rows, *ENTRY_COLUMNS)
            files.close()

        return self.read(both.mapInArrow(pick, ENTRIES), payloads=True)

    def read(self, entries: DataFrame | None = None, payloads: bool = False) -> DataFrame:
        """The records of entries (by default of all captures), each by its byte range."""
        folder = self.folder

        def run(batches):
            files = _Ranges(folder)
            names, types = [*RECORD_COLUMNS[0], *["payload"] * payloads], [*RECORD_COLUMNS[1], *[pa.binary()] * payloads]
            for batch in batches:
                yield _rows([parse(files.read(r["file"], r["offset"], r["length"])) for r in batch.to_pylist()], names, types)
            files.close()

        entries = self.entries() if entries is None else entries
        by_file = entries.select("file", "offset", "length").repartition(partitions(entries.sparkSession), "file").sortWithinPartitions("file", "offset")
        return by_file.mapInArrow(run, CAPTURES if payloads else RECORDS)


def write_archive(pages: DataFrame, folder: str | None = None, least_revisit: int = LEAST_REVISIT) -> Archive:
    """Write a record per row of pages (page_id, url, html; other columns are not read) and the index.

    Null html: an empty payload; null url: an empty one; a null page_id stays null and counts as the smallest. Of payloads that are equal and
    not shorter than least_revisit bytes, the smallest page_id's is a response and the others are revisits of it; repeated rows
    of that page are all responses. An empty table gives an archive without files. URLs lose white space inside them.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    key = F.struct(F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("id"))
    long_ones = p.where(F.octet_length("html") >= least_revisit).groupBy("digest", "page_id").agg(F.lit(1).alias("one"))
    first = long_ones.groupBy("digest").agg(F.min(key).alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", "f")
    revisits = long_ones.join(first, "digest").where(key != F.col("f")).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.when(F.col("f.known"), F.col("f.id")).alias("first"), F.lit(True).alias("revisit"))
    marked = p.join(revisits, (F.col("page_id").eqNullSafe(F.col("_page"))) & (F.col("digest") == F.col("_digest")), "left")
    chosen = marked.select("page_id", "url", "html", "digest", "first", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    captures = cut(chosen.mapInArrow(lambda it: _write_records(it, folder), ENTRIES))
    ordered = captures.repartitionByRange(partitions(spark), "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return Archive(folder, cut(ordered.mapInArrow(lambda it: _write_blocks(it, folder), BLOCKS)))


def op7_indexed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of the table is looked up in the index, and its records are read by their ranges."""
    pages = table(spark, sf_dir, "pages")
    found = write_archive(pages).find(pages.select(F.coalesce("url", F.lit("")).alias("url")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> f THEN f END AS refers_to
FROM (SELECT page_id, h, d, min(page_id) OVER (PARTITION BY d) AS f
      FROM (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages))
"""
