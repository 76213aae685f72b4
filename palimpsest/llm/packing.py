"""Packing documents into training sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents are dealt by a hash to groups of about GROUP_BYTES of text; a group is one task's work and needs no other group. In a
group every document is tokenized, cut into full sequences and a rest, and the rests are placed longest first into the first bin
with room; a tournament tree over the bins' free space finds that bin in log time. The emptiest bins are then dissolved: their
documents are cut to fill the gaps left in the other bins.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed

SEQUENCE, END_ID = 4096, 2
GROUP_BYTES = 12_000_000
#: Gaps shorter than this stay: a document isn't cut for less.
LEAST_CUT = 16
#: Bytes of text that are coded at once; letters of a run that a matrix takes.
CODED_BYTES, MOST_LETTERS = 4_000_000, 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BinTree:
    """A tournament tree of free space: leaves are bins, an inner node holds the most free space below it."""

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.size = capacity, 1 << max(0, (max(1, bins) - 1).bit_length())
        self.most = [capacity] * (2 * self.size)

    def first_fit(self, length: int) -> int:
        """Take `length` from the first bin that has it and return the bin."""
        most, i = self.most, 1
        if most[1] < length:
            raise ValueError("no bin has so much room")
        while i < self.size:
            i *= 2
            if most[i] < length:
                i += 1
        most[i] -= length
        leaf = i - self.size
        while i > 1:
            i //= 2
            best = max(most[2 * i], most[2 * i + 1])
            if most[i] == best:
                break
            most[i] = best
        return leaf

    def free(self, leaf: int) -> int:
        return self.most[self.size + leaf]


def pack(lengths: list[int], capacity: int = SEQUENCE, least_cut: int = LEAST_CUT) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, bin, offset) of items of the given lengths, in bins of `capacity`. Lengths of 0 give no piece."""
    pieces, rests, n_bins = [], [], 0
    for i, n in enumerate(lengths):
        full = n // capacity
        pieces += [(i, k * capacity, capacity, n_bins + k, 0) for k in range(full)]
        n_bins += full
        if n % capacity:
            rests.append((n % capacity, i))
    rests.sort(key=lambda x: (-x[0], x[1]))
    bound = min(len(rests), 1 + 2 * sum(n for n, _ in rests) // capacity)  # any two neighbouring bins of a first fit hold more than one capacity
    tree, placed = BinTree(capacity, bound), []
    for n, i in rests:
        placed.append((tree.first_fit(n), n, i))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for b, n, i in placed:
        bins.setdefault(b, []).append((i, lengths[i] - n, n))
    return pieces + [(i, s, n, n_bins + b, o) for i, s, n, b, o in _dissolve(bins, capacity, least_cut)]


def _dissolve(bins: dict[int, list[tuple[int, int, int]]], capacity: int, least_cut: int) -> list[tuple[int, int, int, int, int]]:
    """Cut what lies in the emptiest bins to fill the other bins' gaps; number the bins that are left from 0."""
    load = {b: sum(n for _, _, n in x) for b, x in bins.items()}
    order = sorted(bins, key=lambda b: (-load[b], b))
    last, at, spare = len(order) - 1, 0, []
    while at < len(order):
        b = order[at]
        gap = capacity - load[b]
        while gap >= least_cut and (spare or last > at):
            if not spare:
                spare, last = bins.pop(order[last])[::-1], last - 1
            i, s, n = spare.pop()
            took = min(n, gap)
            if n > took and n - took < least_cut and took > least_cut:
                took = max(least_cut, took - least_cut)
            bins[b].append((i, s, took))
            gap -= took
            if n > took:
                spare.append((i, s + took, n - took))
                if gap < 2 * least_cut:
                    break
        at += 1
        if at > last:
            break
    order = order[: last + 1]
    if spare:  # what is left of a dissolved bin keeps a bin
        bins[-1], order = spare[::-1], [*order, -1]
    out = []
    for k, b in enumerate(order):
        offset = 0
        for i, s, n in bins[b]:
            out.append((i, s, n, k, offset))
            offset += n
    return out


#: What the fast path below rests on: fixed values of the tokenizer's file.
LOWER_WORDS = {"normalizers": ["NFC", "Replace", "Lowercase"], "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "word_end": "</w>"}
#: ASCII marks that may follow a word's letters and then form a pre-token of their own.
MARKS = ".,;:!?#*$%&|<>()[]{}=+-/\\\"_~^@"


class Merger:
    """The merges of a byte-pair file, applied to many runs of letters at once.

    Runs of one length form a matrix. In each step every run merges its leftmost pair of the lowest rank, which is the order the
    tokenizer itself keeps, and so becomes one symbol shorter; runs without a pair to merge leave the matrix.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, word_end: str):
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([vocabulary[alphabet[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[alphabet[b] + word_end] for b in range(256)], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        self.none = len(pairs)
        self.merged = np.array([vocabulary[x + y] for x, y in pairs], np.int32)
        self.bits = max(8, (4 * len(pairs)).bit_length())
        keys, ranks = [-1] * (2 << self.bits), [self.none] * (2 << self.bits)
        known = np.array([(vocabulary[x] << 32) | vocabulary[y] for x, y in pairs], np.int64)
        for rank, (key, slot) in enumerate(zip(known.tolist(), self._slots(known).tolist(), strict=True)):
            while keys[slot] >= 0:
                slot += 1
            keys[slot], ranks[slot] = key, rank
        self.keys, self.ranks = np.array(keys, np.int64), np.array(ranks, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; that of no merge if there is none."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slots(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], np.int32(self.none))
        open_ = np.nonzero((found != key) & (found >= 0))
        while len(open_[0]):
            slot[open_] += 1
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[tuple(x[hit] for x in open_)] = self.ranks[slot[open_]][hit]
            open_ = tuple(x[~hit & (found >= 0)] for x in open_)
        return out

    def merge(self, letters: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """letters: a run of bytes a row. Gives (rows, ids), a row of ids each, by the number of ids."""
        if not len(letters):
            return []
        s = np.vstack([self.inner[letters.T[:-1]], self.last[letters.T[-1:]]])
        r, rows, out = self.rank(s[:-1], s[1:]), np.arange(len(letters)), []
        while True:
            best = r.min(0) if len(r) else np.full(len(rows), self.none, np.int32)
            live = best < self.none
            if not live.all():
                out.append((rows[~live], s[:, ~live].T))
                rows, s, r, best = rows[live], s[:, live], r[:, live], best[live]
            if not len(rows):
                return out
            j, cols = r.argmin(0), np.arange(len(rows))
            k = np.arange(len(s) - 1)[:, None]
            s = np.where(k < j, s[:-1], s[1:])
            s[j, cols] = self.merged[best]
            r = np.where(k[:-1] < j, r[:-1], r[1:])
            for at, has in ((j, j < len(r)), (j - 1, j > 0)):
                at, c = at[has], cols[has]
                r[at, c] = self.rank(s[at, c], s[at + 1, c])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all segments, one segment after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class _Pool:
    """Segments of ids, one after another."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Start of each of the segments that lie in ids one after another."""
        starts = self.size + np.cumsum(lengths) - lengths
        self.parts.append(np.asarray(ids, np.uint32))
        self.size += len(ids)
        return starts

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.parts])


class WordCoder:
    """Ids of texts, word by word. The tokenizer's normaliser and splitter never join what ASCII white space separates, so a text's
    ids are its words' ids one after another, and the distinct words of many texts are coded once. Nothing is kept between calls.

    Most words are letters, perhaps followed by marks: two pre-tokens at most, and the letters in lower case. Their letters go
    through a Merger, which is held against the tokenizer when it is made. Any other word, and any file with other rules than
    LOWER_WORDS, goes through the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        normal, split, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
        known = [x["type"] for x in normal.get("normalizers", [])] == LOWER_WORDS["normalizers"] and split.get("pretokenizers", [{}])[0].get("pattern") == {"Regex": LOWER_WORDS["split"]}
        self.merger = None
        if known and model.get("type") == "BPE" and model.get("end_of_word_suffix") == LOWER_WORDS["word_end"] and not model.get("ignore_merges"):
            self.merger = Merger(model["vocab"], model["merges"], LOWER_WORDS["word_end"])
            letters = [w.removesuffix(LOWER_WORDS["word_end"]) for w in model["vocab"]]
            sample = [a + b for a, b in zip(letters[::97], letters[50::97], strict=False) if (a + b).isascii() and (a + b).isalpha() and (a + b).islower()]
            ids, sizes = self._letters(pa.array(sample, pa.string()))
            got, want = np.split(ids, np.cumsum(sizes)[:-1]), self.tokenizer.encode_batch_fast(sample, add_special_tokens=False)
            if any(x.tolist() != e.ids for x, e in zip(got, want, strict=True)):
                raise ValueError("the merges do not give the tokenizer's ids")

    def _tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has, by the tokenizer."""
        found = [e.ids for at in range(0, len(words), 1024) for e in self.tokenizer.encode_batch_fast(words[at : at + 1024], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _letters(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same of runs of lower-case letters; long ones go through the tokenizer."""
        at, data = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64), np.frombuffer(words.buffers()[2] or b"", np.uint8)
        sizes, found = np.diff(at), []
        for n in range(1, MOST_LETTERS + 1):
            of = np.flatnonzero(sizes == n)
            found += [(of[rows], ids) for rows, ids in self.merger.merge(data[at[of][:, None] + np.arange(n)])]
        long_ = np.flatnonzero(sizes > MOST_LETTERS)
        long_ids, long_sizes = self._tokenized([words[i].as_py() for i in long_.tolist()])
        counts = np.zeros(len(words), np.int64)
        counts[long_] = long_sizes
        for rows, ids in found:
            counts[rows] = ids.shape[1]
        starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.uint32)
        out[spread(starts[long_], long_sizes)] = long_ids
        for rows, ids in found:
            out[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, counts

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, END_ID after each text's, and how many each text has."""
        if self.merger is None:
            ids, sizes = self._tokenized(texts.to_pylist())
            return np.insert(ids, np.cumsum(sizes), END_ID), sizes + 1
        split = pc.ascii_split_whitespace(texts)
        coded, ends = split.values.dictionary_encode(), np.asarray(split.offsets)[1:]
        start, length, pool = self._words(coded.dictionary)
        words = np.insert(np.asarray(coded.indices), ends, len(start) - 1)  # the last is the end of a text
        lengths = length[words]
        before = np.r_[0, np.cumsum(lengths)]
        sizes = np.diff(before[np.r_[0, ends + np.arange(1, len(ends) + 1)]])
        return pool[spread(start[words], lengths)], sizes

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of the ids of each of the distinct words and of the end, and the ids they lie in."""
        cores = pc.ascii_rtrim(words, characters=MARKS).dictionary_encode()
        each, of = cores.dictionary, np.asarray(cores.indices)
        plain, low = np.array(pc.or_(pc.ascii_is_alpha(each), pc.equal(each, ""))), pc.ascii_lower(each)
        other = np.flatnonzero(~plain)
        if len(other):
            lowered = []
            for s in each.take(pa.array(other)).to_pylist():
                t = s.lower()
                lowered.append(t if t.isalpha() and "\u03a3" not in s and unicodedata.is_normalized("NFC", s) else None)
            low = pc.replace_with_mask(low, pa.array(~plain), pa.array(lowered, pa.string()))
        runs = low.dictionary_encode()
        pool, n = _Pool(), len(words)
        ids, sizes = self._letters(runs.dictionary)
        run_start = pool.add(ids, sizes)
        run = np.asarray(pc.fill_null(runs.indices, -1))[of]
        start, length = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        if len(sizes):
            start[:n], length[:n] = run_start[run], np.where(run >= 0, sizes[run], 0)
        odd = np.flatnonzero(run < 0)
        ids, sizes = self._tokenized(words.take(pa.array(odd)).to_pylist())
        start[odd], length[odd] = pool.add(ids, sizes), sizes
        marked = np.flatnonzero((np.asarray(pc.binary_length(words)) > np.asarray(pc.binary_length(cores.dictionary))[of]) & (run >= 0))
        tails = pa.array([w[len(w.rstrip(MARKS)) :] for w in words.take(pa.array(marked)).to_pylist()], pa.string()).dictionary_encode()
        ids, sizes = self._tokenized(tails.dictionary.to_pylist())
        mark_start, mark = pool.add(ids, sizes), np.asarray(tails.indices)
        start[n], length[n] = pool.add(np.array([END_ID]), np.array([1]))[0], 1
        second, more = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        second[marked], more[marked] = mark_start[mark], sizes[mark]
        pieces, sizes = np.stack([start, second], 1).reshape(-1), np.stack([length, more], 1).reshape(-1)
        length = length + more
        return np.cumsum(length) - length, length, pool.ids()[spread(pieces, sizes)]


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One for each Python worker, which outlives tasks: the tokenizer and its merges, of fixed size."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def slices(texts: pa.StringArray, most: int) -> list[tuple[int, int]]:
    """Stretches [from, to) of about `most` bytes of text each, one text at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    if not len(ends):
        return []
    cuts = np.flatnonzero(np.diff(ends // most)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)], strict=True))


def _pack_group(batches: Iterator[pa.RecordBatch], path: str, group: int) -> Iterator[pa.RecordBatch]:
    """Pack the rows of one task."""
    code, ids, docs = coder(path), [], []
    for batch in batches:
        docs += batch.column(0).to_pylist()
        for low, high in slices(batch.column(1), CODED_BYTES):
            flat, sizes = code.encode(batch.column(1).slice(low, high - low))
            raw, ends = memoryview(flat.astype("<u4").tobytes()), (4 * np.cumsum(sizes)).tolist()
            ids += [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]
    order = sorted(range(len(ids)), key=lambda i: (docs[i] is not None, docs[i] or 0, zlib.crc32(ids[i]), len(ids[i])))
    docs, ids = [docs[i] for i in order], [ids[i] for i in order]
    rows = pack([len(x) // 4 for x in ids])
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([docs[i] for i, *_ in part], pa.int64()),
                pa.array([s for _, s, *_ in part], pa.int64()),
                pa.array([n for _, _, n, *_ in part], pa.int64()),
                pa.array([zlib.crc32(ids[i][4 * s : 4 * (s + n)]) for i, s, n, *_ in part], pa.int64()),
                pa.array([len(ids[i]) // 4 for i, *_ in part], pa.int64()),
                pa.array([(group << 32) + b for _, _, _, b, _ in part], pa.int64()),
                pa.array([o for *_, o in part], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pack the texts of docs into sequences of at most SEQUENCE ids; every text's ids are followed by END_ID.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Other columns of docs are not
    read. Null or empty text: the end id alone. A null doc_id stays null. Each of repeated rows is packed by itself. A text of
    any length is cut into full sequences first. An empty table gives no rows. The group is hashed from doc_id and text (rows without
    a doc_id are dealt by their place, so that many equal ones do not meet), rows are ordered in it, and sequence_id is the group's
    number times 2^32 plus the bin's.
    vocabulary: path of the tokenizer's file, on every executor; by default that of the installed public tokenizer.
    """
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(groups, F.xxhash64(F.lit("pack"), F.coalesce("doc_id", F.monotonically_increasing_id()), F.crc32(F.substring("text", 1, 256).cast("binary")), F.length("text")))

    def run(batches):
        from pyspark import TaskContext

        yield from trimmed(_pack_group(batches, vocabulary or default_vocabulary(), TaskContext.get().partitionId()))

    return dealt.mapInArrow(run, PIECES)


def op4_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
