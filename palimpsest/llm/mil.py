"""Quality of documents by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages. Every passage is encoded by hashed word features and its shape (case, digits, marks, repeats), then
by a tanh layer; a gated attention (tanh times sigmoid) weighs the passages, and a logistic unit scores the weighted sum. Only the
document's label is known, the attention is learnt from it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Words of a passage; passages of a document at most (longer texts have longer passages); buckets of words; size of the layers.
PASSAGE, PASSAGES, BUCKETS, HIDDEN, GATE = 64, 64, 192, 24, 12
#: Labelled documents the model is fitted on at most (the smallest hashes of doc_id), rounds over them, documents of a step, rate.
MOST_TRAINING, ROUNDS, STEP, RATE, DECAY = 4000, 30, 64, 0.01, 1e-3
THRESHOLD = 0.3
SHAPES = 14


UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def _shape(words: list[str], lower: list[str]) -> list[float]:
    """Measures of a passage that don't depend on its vocabulary."""
    n, joined = max(1, len(words)), "".join(words).encode()
    chars = max(1, len(joined))
    of = lambda marks: len(joined) - len(joined.translate(None, marks))
    upper, high = of(UPPER), of(bytes(range(128, 256)))
    titles = "".join([w[:1] for w in words]).encode()
    return [
        np.log1p(n) / 5,
        chars / n / 8,
        (upper + of(LOWER) + high) / chars,
        upper / chars,
        of(DIGITS) / chars,
        of(b"#*$%&|<>") / n,
        of(b".!?") / n,
        of(b"!") / n,
        len(set(lower)) / n,
        len(set(zip(lower, lower[1:], strict=False))) / n,
        (len(titles) - len(titles.translate(None, UPPER))) / n,
        sum([len(w) > 20 for w in words]) / n,
        sum([w.isupper() for w in words if len(w) > 1]) / n,
        high / chars,
    ]


#: Bucket and sign of words, remembered by a worker up to a number of words.
_PLACES: dict[str, int] = {}
REMEMBER = 300_000


def _place(word: str) -> int:
    """Twice the bucket of a word, and one more where it counts against it."""
    i = _PLACES.get(word)
    if i is None:
        h = zlib.crc32(word.encode())
        if len(_PLACES) >= REMEMBER:
            _PLACES.clear()
        i = _PLACES[word] = 2 * (h % BUCKETS) + (h >> 31)
    return i


def passages(text: str | None) -> np.ndarray:
    """Features of all passages of a whole text; one passage without words for an empty one."""
    words = (text or "").split()
    size = max(PASSAGE, -(-len(words) // PASSAGES))
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    whole = [np.log1p(len(words)) / 8, 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / max(1, len(words))]
    rows = []
    for at in range(0, max(1, len(words)), size):
        part = words[at : at + size]
        lower = [w.lower() for w in part]
        n = np.bincount(np.array([_place(w) for w in lower], np.int64), minlength=2 * BUCKETS).reshape(-1, 2)
        x = (n[:, 1] - n[:, 0]).astype(np.float64)
        x /= max(1.0, np.linalg.norm(x))
        rows.append(np.r_[x, _shape(part, lower), whole])
    return np.array(rows, np.float32)


@dataclass
class Model:
    """mean, scale of the features; e: encoder; v, u: the gates; w: weight of a passage; o: output."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """x: features of passages, bag: document of each, ascending; n: documents."""
        p, z = self.p, (x - self.mean) / self.scale
        h = np.tanh(z @ p["e"] + p["eb"])
        a, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = np.clip((a * g) @ p["w"], -30, 30)
        k = np.exp(s)
        k /= np.bincount(bag, k, n)[bag]
        m = np.stack([np.bincount(bag, k * h[:, j], n) for j in range(h.shape[1])], 1)
        y = 1 / (1 + np.exp(-np.clip(m @ p["o"] + p["ob"], -30, 30)))
        return {"z": z, "h": h, "a": a, "g": g, "k": k, "m": m, "y": y}

    def gradients(self, x: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bag, len(labels))
        d = (f["y"] - labels) / len(labels)
        dm = d[:, None] * p["o"]
        pulled = (dm[bag] * f["h"]).sum(1)  # effect of each passage's weight
        mean = np.bincount(bag, f["k"] * pulled, len(labels))[bag]
        ds = f["k"] * (pulled - mean)
        dag = ds[:, None] * p["w"]
        da, dg = dag * f["g"] * (1 - f["a"] ** 2), dag * f["a"] * f["g"] * (1 - f["g"])
        dh = (f["k"][:, None] * dm[bag] + da @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"e": f["z"].T @ dh, "eb": dh.sum(0), "v": f["h"].T @ da, "u": f["h"].T @ dg, "w": (f["a"] * f["g"]).T @ ds, "o": f["m"].T @ d, "ob": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: list[int]) -> Model:
    """Adam on the cross entropy of documents' labels. Without documents of both labels every score is the share of label 1 (half, if there are none)."""
    size = BUCKETS + SHAPES + 3
    rng = np.random.default_rng(5)
    y = np.array(labels, np.float64)
    draw = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    share = np.clip(y.mean(), 0.02, 0.98) if len(y) else 0.5
    p = {"e": draw(size, HIDDEN), "eb": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "w": rng.normal(0, 0.3, GATE), "o": np.zeros(HIDDEN), "ob": np.array([np.log(share / (1 - share))])}
    every = np.concatenate(bags) if bags else np.zeros((1, size))
    model = Model(every.mean(0).astype(np.float64), every.std(0).astype(np.float64) + 0.05, p)
    if len(set(labels)) < 2:
        return model
    first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            x, bag = np.concatenate([bags[i] for i in part]), np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            t += 1
            for k, g in model.gradients(x, bag, y[part]).items():
                g = g + (DECAY * p[k] if k in ("e", "o") else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([passages(text).astype("<f4").tobytes()], pa.binary()), pa.array([label], pa.int32())], names=["x", "quality"])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1).to_pylist()
        scores: list[np.ndarray] = []
        for at in range(0, len(texts), 256):
            bags = [passages(t) for t in texts[at : at + 256]]
            scores.append(model.forward(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))["y"])
        yield pa.RecordBatch.from_arrays([docs, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])


def is_held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, most_training: int = MOST_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs (doc_id, text); labels: doc_id, quality.

    The model sees only texts. It is fitted on at most most_training labelled documents that aren't held out, those with the
    smallest hashes of doc_id; that bound is the only one, every text is scored as a whole. Null text: empty, scored like any
    other. A null doc_id is not held out and has no label. A null label is none; of several labels of a document the smallest
    holds, and of repeated rows one is learnt from. Without labels every score is 0.5. An empty table gives no rows.
    """
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.where(~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_training)
    chosen = cut(chosen)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    learnt = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # most_training rows at most
    rows = learnt.select("text", "quality").mapInArrow(_encode, "x binary, quality int").collect()
    rows.sort(key=lambda r: (r.quality, bytes(r.x)))
    width = BUCKETS + SHAPES + 3
    model = fit([np.frombuffer(r.x, "<f4").reshape(-1, width) for r in rows], [r.quality for r in rows])
    scored = d.mapInArrow(lambda b, m=model: _score(b, m), "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
