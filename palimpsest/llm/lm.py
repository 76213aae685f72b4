"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

The two tokens before a token give a context vector q = c1*r(w1) + c2*r(w2). Every word has a leaf, leaves lie in groups, and a
token's probability is that of its group, times that of its leaf in the group, both a softmax of q by batched matrix products,
times the word's share of its leaf. Frequent words have a leaf to themselves, with a share of 1; each other word, seen or not,
has the leaf of its ending, which all words with that hash of their last bytes share by their add-half counts, an unseen word of
that ending included. So the probabilities of all words, and one unseen word an ending, add up to 1, whatever the context.

What is kept of the size of the corpus stays distributed:

1. Documents are dealt to shards by a hash of their content, whatever partitions the input has, and are tokenized once: a shard
   is a list of distinct words, known by 64-bit hashes, and a stream of places in it.
2. Words with their counts in training documents are dealt by their hashes, summed over all shards, and the sums go back.
3. Shards are coded: leaves of tokens, and what of the scores needs counts only.
4. In each of ROUNDS rounds every shard trains on its next part of its training tokens from the same parameters; a row of
   parameters is then averaged over the shards that changed it, by steps. All training tokens are used once.

Only the most frequent words (their number is the model's size), sums by ending and parameters reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned_up, discard, stored, table
from .packing import slices

#: Bytes of text of a shard; rounds of training; tokens of a step; noise samples of groups and of leaves of a group; learning rate.
SHARD_BYTES, ROUNDS, STEP, NOISE, LEAF_NOISE, RATE = 8 << 20, 4, 16384, 32, 16, 0.1
DIM = 16
#: The end of a text as a token; no word has a space.
END = b" "
SHARDS = "shard long, docs array<long>, held array<boolean>, sizes array<int>, tokens binary, hashes binary, endings binary, counts binary, trained long"
BLOCKS = "part long, shard long, places binary, hashes binary, endings binary, counts binary"
TOTALS = "kind string, shard long, places binary, totals binary, hash long, total long, ending int, block int, sums binary"
CODED = "shard long, docs array<long>, held array<boolean>, sizes array<int>, known array<int>, base array<double>, tail array<double>, leaves binary"
SUMS = "block int, sums binary"


@dataclass(frozen=True)
class Size:
    """The model's size, whatever the corpus: words with a leaf of their own, endings, leaves of a group, bytes of an ending."""

    words: int = 28672
    endings: int = 4096
    members: int = 256
    ending_bytes: int = 4


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _endings(words: list[bytes], size: Size) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(w[-size.ending_bytes :], 5) % size.endings for w in words), np.int32, len(words))


def tokenized(texts: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of the texts, places of all tokens in them, and tokens of each text: words in ASCII lower case, split at the
    six ASCII spaces, then the end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded, ends = split.values.dictionary_encode(), np.asarray(split.offsets)[1:]
    words, places = coded.dictionary.cast(pa.binary()).to_pylist(), np.asarray(coded.indices)
    if b"" in words:  # before and after the words of a text
        full = places != words.index(b"")
        ends, places = np.r_[0, np.cumsum(full)][ends], places[full]
    places = np.insert(places, ends, len(words))
    return [*words, END], places.astype(np.int32), np.diff(np.r_[0, ends]).astype(np.int32) + 1


def _deal(batches: Iterator[pa.RecordBatch], size: Size, part: int) -> Iterator[pa.RecordBatch]:
    """Shards of a task's documents."""
    k = 0
    for batch in batches:
        for low, high in slices(batch.column(2), SHARD_BYTES):
            docs, held, texts = (batch.column(i).slice(low, high - low) for i in range(3))
            words, places, sizes = tokenized(texts)
            training = np.repeat(~np.asarray(held), sizes)
            counts = np.bincount(places[training], minlength=len(words)).astype(np.int32)
            lists = [docs, held, pa.array(sizes)]
            arrays = [places, _hashes(words), _endings(words, size), counts]
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists] + [pa.array([x.tobytes()], pa.binary()) for x in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 20) + k], pa.int64()), *one, pa.array([int(training.sum())], pa.int64())], names=[x.split()[0] for x in SHARDS.split(", ")])
            k += 1


def _split(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The words of shards, a row per part of all hashes."""
    for batch in batches:
        for shard, hashes, endings, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            h, e, c = np.frombuffer(hashes, np.int64), np.frombuffer(endings, np.int32), np.frombuffer(counts, np.int32)
            part = (h.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            here, first = np.unique(part[order], return_index=True)
            pick = [np.split(x[order].astype(t), first[1:]) for x, t in ((np.arange(len(h)), np.int32), (h, np.int64), (e, np.int32), (c, np.int32))]
            for at in range(0, len(here), 1000):
                rows = slice(at, at + 1000)
                yield pa.RecordBatch.from_arrays([pa.array(here[rows]), pa.array([shard] * len(here[rows]), pa.int64()), *[pa.array([x.tobytes() for x in p[rows]], pa.binary()) for p in pick]], names=["part", "shard", "places", "hashes", "endings", "counts"])


def _totals(batches: Iterator[pa.RecordBatch], size: Size, least: int) -> Iterator[pa.RecordBatch]:
    """Counts over all shards of the words of a task: back to the shards, those that may be frequent, and sums by ending."""
    rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)]
    if not rows:
        return
    names = [x.split()[0] for x in TOTALS.split(", ")]
    types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def out(kind: str, n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * n if x == "kind" else given.get(x, [None] * n), t) for x, t in zip(names, types, strict=True)], names=names)

    h, e, c = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((2, np.int64), (3, np.int32), (4, np.int32)))
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    total = np.add.reduceat(c[order].astype(np.int64), np.flatnonzero(new))
    back = np.empty(len(h), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    cuts = np.cumsum([len(r[1]) // 4 for r in rows])
    yield out("back", len(rows), shard=[r[0] for r in rows], places=[r[1] for r in rows], totals=[x.tobytes() for x in np.split(back, cuts[:-1])])
    word, ending = h[order][new], e[order][new]
    seen = total > 0
    by = np.stack([np.bincount(ending[seen], total[seen], size.endings), np.bincount(ending[seen], minlength=size.endings)], 1)
    yield out("ending", 1, block=[0], sums=[by.astype(np.float64).tobytes()])
    many = np.flatnonzero(total >= least)
    if len(many):
        yield out("word", len(many), hash=word[many], total=total[many], ending=ending[many])


def _sum(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Sums of arrays by block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw, kind)
            sums[block] = sums[block] + x if block in sums else x.astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])


def summed(rows: DataFrame, kind: str, combine: bool = True) -> dict[int, np.ndarray]:
    """The arrays of rows (block, sums: bytes of numbers of the kind) added up by block. Their size does not depend on the data."""
    if combine:
        rows, kind = rows.mapInArrow(lambda b, k=kind: _sum(b, k), SUMS), "f8"
    done = rows.repartition(32, "block").mapInArrow(lambda b, k=kind: _sum(b, k), SUMS)
    with cleaned_up(rows.sparkSession):
        return {r.block: np.frombuffer(r.sums, np.float64) for r in done.collect()}


class Words:
    """The leaf and the share of the leaf of any word.

    hashes, counts: of the words with a leaf of their own, most frequent first; total and distinct: of all training tokens;
    rest: sums of counts and number of the other words, by ending."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: np.ndarray, total: int, distinct: int, size: Size):
        self.counts, self.rest, self.total, self.distinct, self.size = counts, rest, total, distinct, size
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.leaves = len(hashes) + size.endings

    def leaf(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        other = len(self.sorted) + endings
        if not len(self.sorted):
            return other
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], other)

    def share(self, leaves: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Share of a word, by its count, of its leaf."""
        ending = np.maximum(leaves - len(self.sorted), 0)
        size = self.rest[ending, 0] + 0.5 * (self.rest[ending, 1] + 1)
        return np.where(leaves < len(self.sorted), 1.0, (counts + 0.5) / size)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))


class Model:
    """Vectors and biases: r, c of contexts (one more vector for the place before a text), t of leaves, g of groups; the last
    column of t and g is the bias. s*: sums of squared gradients, one a row."""

    NAMES = ("t", "st", "r", "sr", "g", "sg", "c", "sc")

    def __init__(self, words: Words):
        n, self.members = words.leaves, words.size.members
        self.groups = -(-n // self.members)
        share = np.r_[words.counts, words.rest[:, 0]] + 0.5
        self.sizes = np.diff(np.r_[np.arange(0, n, self.members), n])
        of = np.add.reduceat(share, np.arange(0, n, self.members))
        self.share = of / of.sum()
        rng = np.random.default_rng(7)
        column = lambda x: np.c_[np.zeros((len(x), DIM)), np.log(x)].astype(np.float32)
        self.t, self.g = column(share / np.repeat(of, self.sizes)), column(self.share)
        self.r = rng.normal(0, 0.3, (n + 1, DIM)).astype(np.float32)
        self.c = (np.ones((2, DIM)) * np.array([[1.0], [0.5]])).astype(np.float32)
        self.st, self.sr, self.sg, self.sc = (np.full(len(x), 0.1, np.float32) for x in (self.t, self.r, self.g, self.c))

    def contexts(self, leaves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two leaves before each token; those before a text are one that no word has."""
        w1, w2, first = np.roll(leaves, 1), np.roll(leaves, 2), np.cumsum(sizes) - sizes
        w1[first] = w2[first] = w2[first[sizes > 1] + 1] = len(self.t)
        return w1, w2

    def query(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Context vectors, with a 1 for the bias."""
        q = np.ones((len(w1), DIM + 1), np.float32)
        q[:, :DIM] = self.r[w1] * self.c[0] + self.r[w2] * self.c[1]
        return q

    def logs(self, leaves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's leaf, normalised over groups and over the leaves of its group."""
        out, (w1, w2) = np.empty(len(leaves)), self.contexts(leaves, sizes)
        for at in range(0, len(leaves), 2 * STEP):
            order = at + np.argsort(leaves[at : at + 2 * STEP], kind="stable")
            target, q = leaves[order].astype(np.int64), self.query(w1[order], w2[order])
            group = target // self.members
            found = self._log_softmax(q @ self.g.T, group)
            for k, low, high in _runs(group):
                base = k * self.members
                found[low:high] += self._log_softmax(q[low:high] @ self.t[base : base + self.sizes[k]].T, target[low:high] - base)
            out[order] = found
        return out

    @staticmethod
    def _log_softmax(s: np.ndarray, at: np.ndarray) -> np.ndarray:
        picked = s[np.arange(len(s)), at].astype(np.float64)
        with np.errstate(over="ignore"):
            total = np.exp(s).sum(1)
        far = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))  # beyond what single numbers hold without their greatest taken off
        logs = np.log(total, where=total > 0, out=np.zeros(len(s)))
        if len(far):
            top = s[far].max(1)
            logs[far] = top + np.log(np.exp(s[far] - top[:, None]).sum(1))
        return picked - logs

    def step(self, target: np.ndarray, w1: np.ndarray, w2: np.ndarray, rng: np.random.Generator, steps: dict[str, np.ndarray]) -> None:
        """One step of noise-contrastive estimation: tell each token's group from NOISE draws of groups by their shares, and its leaf
        from LEAF_NOISE evenly drawn ones of its group, shared by the step's tokens of that group. steps counts a row's changes."""
        order = np.argsort(target, kind="stable")
        target, w1, w2 = target[order].astype(np.int64), w1[order], w2[order]
        q, group = self.query(w1, w2), target // self.members
        noise = rng.choice(self.groups, NOISE, p=self.share)
        low = np.log(NOISE * self.share).astype(np.float32)
        up = _below((q * self.g[group]).sum(1) - low[group])
        down = -_below(low[noise] - q @ self.g[noise].T)
        dq = up[:, None] * self.g[group] + down @ self.g[noise]
        dg, runs = np.zeros_like(self.g), _runs(group)
        here = np.array([k for k, *_ in runs])
        dg[here] = np.add.reduceat(up[:, None] * q, [x for _, x, _ in runs])
        np.add.at(dg, noise, down.T @ q)
        self._move("g", np.union1d(here, noise), dg, steps)
        dt, start, n = np.zeros_like(self.t), rng.integers(0, 1 << 30, self.groups), np.minimum(LEAF_NOISE, self.sizes)
        level = np.log(n / self.sizes).astype(np.float32)
        tt = self.t[target]
        up = _below((q * tt).sum(1) - level[group])[:, None]
        dq += up * tt
        touched, scores, drawn = np.zeros(len(dt), bool), np.zeros((len(q), LEAF_NOISE), np.float32), {}
        for k, a, z in runs:
            drawn[k] = k * self.members + (start[k] + np.arange(n[k])) % self.sizes[k]
            np.matmul(q[a:z], self.t[drawn[k]].T, out=scores[a:z, : n[k]])
        down = -_below(level[group][:, None] - scores)
        for k, a, z in runs:
            rows, part = drawn[k], down[a:z, : n[k]]
            dq[a:z] += part @ self.t[rows]
            dt[rows] = part.T @ q[a:z]
            touched[rows] = True
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        dt[target[first]] += np.add.reduceat(up * q, first)
        touched[target[first]] = True
        self._move("t", np.flatnonzero(touched), dt, steps)
        dq, dr = dq[:, :DIM], np.zeros_like(self.r)
        dc = np.stack([(dq * self.r[w]).sum(0) for w in (w1, w2)]) / len(target)
        touched = np.zeros(len(dr), bool)
        for w, c in ((w1, self.c[0]), (w2, self.c[1])):
            by = np.argsort(w, kind="stable")
            w = w[by]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            dr[w[first]] += np.add.reduceat(dq[by], first) * c
            touched[w[first]] = True
        self._move("r", np.flatnonzero(touched), dr, steps)
        self._move("c", np.arange(2), dc, steps)

    def _move(self, name: str, rows: np.ndarray, gradient: np.ndarray, steps: dict[str, np.ndarray]) -> None:
        g, x, s = gradient[rows], getattr(self, name), getattr(self, "s" + name)
        s[rows] += (g * g).mean(1)
        x[rows] += RATE * g / np.sqrt(s[rows])[:, None]
        steps[name][rows] += 1

    def packed(self, steps: dict[str, np.ndarray]) -> np.ndarray:
        """All rows of parameters and sums times their steps, and the steps."""
        return np.concatenate([(np.c_[getattr(self, n), getattr(self, "s" + n), np.ones(len(getattr(self, n)), np.float32)] * steps[n][:, None]).reshape(-1) for n in "trgc"])

    def unpack(self, sums: np.ndarray) -> None:
        """Rows that were changed become their averages by steps."""
        at = 0
        for n in "trgc":
            x, s = getattr(self, n), getattr(self, "s" + n)
            rows = sums[at : at + len(x) * (x.shape[1] + 2)].reshape(len(x), -1)
            at += rows.size
            some = rows[:, -1] > 0
            mean = rows[some] / rows[some, -1:]
            x[some], s[some] = mean[:, :-2], mean[:, -2]


def _below(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e^x)."""
    return 1 / (1 + np.exp(np.minimum(x, np.float32(80))))


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, from and to of the runs of equal values."""
    if not len(sorted_):
        return []
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return list(zip(sorted_[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_)], strict=True))


def _code(shard: pa.Table, back: pa.Table, words: Words) -> pa.Table:
    """A shard's tokens as leaves, and per document what its scores take from counts."""
    one = {n: shard.column(n)[0].as_buffer() for n in ("tokens", "hashes", "endings")}
    tokens, hashes, endings = np.frombuffer(one["tokens"], np.int32), np.frombuffer(one["hashes"], np.int64), np.frombuffer(one["endings"], np.int32)
    counts = np.zeros(len(hashes), np.int64)
    for places, totals in zip(back.column("places").to_pylist(), back.column("totals").to_pylist(), strict=True):
        counts[np.frombuffer(places, np.int32)] = np.frombuffer(totals, np.int64)
    leaf = words.leaf(hashes, endings)
    sizes = np.asarray(shard.column("sizes").combine_chunks().values)
    first = np.cumsum(sizes) - sizes
    by_doc = lambda x: np.add.reduceat(x[tokens], first)
    found = [pa.array(by_doc((counts > 0).astype(np.int32)), pa.int32()), pa.array(by_doc(np.log10(words.base(counts)))), pa.array(by_doc(np.log10(words.share(leaf, counts))))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in found]
    same = [shard.column(n).combine_chunks() for n in ("shard", "docs", "held", "sizes")]
    kind = np.uint16 if words.leaves < 1 << 16 else np.int32
    return pa.Table.from_arrays([*same, *lists, pa.array([leaf.astype(kind)[tokens].tobytes()], pa.binary())], names=[x.split()[0] for x in CODED.split(", ")])


def _train(batches: Iterator[pa.RecordBatch], model: Model, turn: int) -> Iterator[pa.RecordBatch]:
    """Each shard of a task trains on its part of the turn from the same start; blocks of the sums over all of them."""
    total, start = None, [getattr(model, n).copy() for n in Model.NAMES]
    for batch in batches:
        for i in range(len(batch)):
            sizes, leaves = np.asarray(batch.column(2)[i].values), _leaves(batch.column(3)[i], len(model.t))
            w1, w2 = model.contexts(leaves, sizes)
            training = np.flatnonzero(np.repeat(~np.asarray(batch.column(1)[i].values.to_numpy(zero_copy_only=False)), sizes))
            part = np.random.default_rng((11, batch.column(0)[i].as_py())).permutation(training)[turn::ROUNDS]
            if not len(part):
                continue
            for n, x in zip(Model.NAMES, start, strict=True):
                getattr(model, n)[...] = x
            rng, steps = np.random.default_rng((13, turn, batch.column(0)[i].as_py())), {n: np.zeros(len(getattr(model, n)), np.float32) for n in "trgc"}
            for at in range(0, len(part), STEP):
                p = part[at : at + STEP]
                model.step(leaves[p], w1[p], w2[p], rng, steps)
            packed = model.packed(steps)
            total = packed if total is None else total + packed
    if total is not None:
        blocks = [total[at : at + 65536].astype(np.float32).tobytes() for at in range(0, len(total), 65536)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "sums"])


def _leaves(raw: pa.BinaryScalar, n: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint16 if n < 1 << 16 else np.int32)


def is_held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _score(batches: Iterator[pa.RecordBatch], model: Model, total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            docs, held, sizes, known, base, tail = (batch.column(k)[i].values for k in range(1, 7))
            n = np.asarray(sizes)
            logs = model.logs(_leaves(batch.column(7)[i], len(model.t)), n)
            score = np.add.reduceat(logs, np.cumsum(n) - n) / log(10) + np.asarray(tail)
            yield pa.RecordBatch.from_arrays([docs, held, sizes.cast(pa.int64()), known.cast(pa.int64()), pa.array([total] * len(n), pa.int64()), base, pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def coded_corpus(docs: DataFrame, size: Size) -> tuple[DataFrame, Words, str]:
    """The coded shards of docs (doc_id, text), what is known of words, and where the shards are stored."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    total_bytes = d.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total_bytes // SHARD_BYTES))
    content = F.xxhash64(F.lit("lm"), F.coalesce("doc_id", F.monotonically_increasing_id()), "text")
    dealt = d.withColumn("_h", content).repartition(parts, "_h").sortWithinPartitions("_h").select("doc_id", "held", "text")

    def deal(batches):
        from pyspark import TaskContext

        yield from _deal(batches, size, TaskContext.get().partitionId())

    shards, shards_at = stored(dealt.mapInArrow(deal, SHARDS), "shards")
    total = shards.agg(F.sum("trained")).first()[0] or 0
    blocks = shards.select("shard", "hashes", "endings", "counts").mapInArrow(lambda b: _split(b, parts), BLOCKS)
    least = max(1, total // (50 * size.words))  # at most 50 times the words of the model are that frequent
    totals, totals_at = stored(blocks.repartition(parts, "part").mapInArrow(lambda b: _totals(b, size, least), TOTALS), "word-totals")
    top = totals.where("kind = 'word'").select("hash", "total", "ending").orderBy(F.desc("total"), "hash").limit(size.words).collect()
    rest = summed(totals.where("kind = 'ending'").select("block", "sums"), "f8").get(0, np.zeros(2 * size.endings)).reshape(-1, 2).copy()
    distinct = int(rest[:, 1].sum())
    counts = np.array([r.total for r in top], np.int64)
    np.subtract.at(rest, np.array([r.ending for r in top], np.int64), np.c_[counts, np.ones(len(top))])
    words = Words(np.array([r.hash for r in top], np.int64), counts, rest, total, distinct, size)
    back = totals.where("kind = 'back'").select("shard", "places", "totals")
    pairs = shards.drop("counts", "trained").groupBy("shard").cogroup(back.groupBy("shard"))
    coded, coded_at = stored(pairs.applyInArrow(lambda a, b: _code(a, b, words), CODED), "coded-shards")
    discard(spark, shards_at, totals_at)
    return coded, words, coded_at


def train(coded: DataFrame, words: Words) -> Model:
    """A model from the training documents of coded shards."""
    model = Model(words)
    for turn in range(ROUNDS if words.total else 0):
        rows = coded.select("shard", "held", "sizes", "leaves").mapInArrow(lambda b, m=model, k=turn: _train(b, m, k), SUMS)
        sums = summed(rows, "f4", combine=False)
        model.unpack(np.concatenate([sums[k] for k in sorted(sums)]))
    return model


def score_documents(docs: DataFrame, size: Size = Size()) -> DataFrame:
    """Scores of all texts by a model that learns from those which is_held_out() leaves.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; other columns are not read. Null text: empty,
    the end alone. A null doc_id isn't held out. Each of repeated rows is scored and learnt from by itself. A text of any length is
    scored whole. An empty table gives no rows; without training documents all probabilities are those of nothing seen. Words are
    told apart by 64-bit hashes.
    """
    coded, words, _ = coded_corpus(docs, size)
    model, total = train(coded, words), words.total
    return coded.mapInArrow(lambda b: _score(b, model, total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
