"""Mixing sources by temperature: weights are token shares to a common exponent, realised as block permutations under a budget.

All of it is DataFrame expressions. The exponent is bisected over aggregates of the table of sources, which stays distributed: a
pass evaluates the points of DEPTH halvings at once, and 2^DEPTH - 1 numbers reach the driver however many sources there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE_RE, cut, fresh, table

#: Halvings a pass, and passes: the exponent is exact to 2^-24.
DEPTH, PASSES = 6, 4
#: Rows of a source that one task orders, on average.
ROWS_PER_BLOCK = 2000


@dataclass(frozen=True)
class Mix:
    """Entropy, as a share of that of equal weights, to reach; None: that which closes the share `close` of the gap between the
    sources' own entropy and that of equal weights. It isn't reached where a source would be repeated more than max_repeats times
    as often as the least repeated one. budget: tokens to deal out; None: the least budget at which every row is dealt out once."""

    entropy: float | None = None
    close: float = 0.5
    max_repeats: float = 2.0
    budget: float | None = None


def _points(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: share of the greatest entropy, and the greatest over the least repetition."""
    cols: list[Column] = []
    for i, a in enumerate(exponents):
        u = F.exp(F.col("_log") * a)
        cols += [F.sum(u).alias(f"z{i}"), F.sum(u * F.col("_log") * a).alias(f"e{i}")]
    row = shares.agg(*cols, F.count("*").alias("n"), F.min("_log").alias("low"), F.max("_log").alias("high"), F.log(F.count("*").cast("double")).alias("top")).first()
    out = []
    for i, a in enumerate(exponents):
        entropy = 1.0 if row.n < 2 else entropy_of(row[f"z{i}"], row[f"e{i}"]) / row.top
        out.append((entropy, math.exp((1 - a) * ((row.high or 0.0) - (row.low or 0.0)))))
    return out


def entropy_of(z: float, e: float) -> float:
    """Entropy of weights u/z where e is the sum of u log u."""
    return math.log(z) - e / z


def exponent(shares: DataFrame, mix: Mix) -> float:
    """The largest exponent in 0..1 that reaches the entropy, raised to the smallest that keeps the repetition limit. Entropy falls
    and repetition falls as the exponent rises, so both have one turning point."""

    def bisect(holds_high) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            step = (high - low) / 2**DEPTH
            grid = [low + step * i for i in range(1, 2**DEPTH)]
            flags = [holds_high(p) for p in _points(shares, grid)]
            first = next((i for i, f in enumerate(flags) if f), len(flags))
            low, high = low + step * first, low + step * (first + 1)
        return low, high

    (_, _), (at_one, _) = _points(shares, [0.0, 1.0])
    target = mix.entropy if mix.entropy is not None else 1 - (1 - at_one) * (1 - mix.close)
    if at_one >= target:
        wanted = 1.0
    elif target >= 1:  # equal weights alone have it; near 0 entropy is too flat for doubles to tell
        wanted = 0.0
    else:
        wanted = bisect(lambda p: p[0] < target)[0]
    allowed = 0.0 if _points(shares, [0.0])[0][1] <= mix.max_repeats else bisect(lambda p: p[1] <= mix.max_repeats)[1]
    return max(wanted, allowed)


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Which documents are dealt out, how often and in what order.

    Returns a row per document and pass: doc_id, source, n_tokens (words), weight (of the source), repeats (budgeted passes of
    the source), pass (from 1), position (place in the mixed stream, in tokens). Other columns of docs are not read.
    Rows of one doc_id and source are one document. A null source is a source like any other, a null doc_id a document like any
    other. Null text and texts without words count as one token, so that they take part too. An empty table gives no rows.

    Each pass is a permutation of the source's documents by a hash of id and pass. The last pass stops where the budget is used
    up: a document belongs to it if it begins within the source's share of the budget, a whole number of tokens. Running sums are taken in blocks of about ROWS_PER_BLOCK
    rows by hash range, and block offsets over the small table of blocks, so no task holds a source.
    """
    tokens = F.greatest(F.lit(1), F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE_RE + "+")), F.lit(0))).cast("long")
    each = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", tokens.alias("n")).groupBy("doc_id", "source").agg(F.sum("n").alias("n_tokens")))
    sources = cut(each.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("_t"), F.count("*").alias("_rows")))
    total = sources.agg(F.sum("_t")).first()[0] or 1.0
    shares = sources.withColumn("_log", F.log(F.col("_t") / total))
    a = exponent(shares, mix) if sources.limit(1).count() else 1.0
    raw = shares.withColumn("_u", F.exp(F.col("_log") * a))
    z = raw.agg(F.sum("_u"), F.max(F.exp(F.col("_log") * (1 - a)))).first()
    budget = mix.budget if mix.budget is not None else total * (z[0] or 1.0) * (z[1] or 1.0)
    weight = F.col("_u") / F.lit(z[0] or 1.0)
    repeats = F.round(weight * F.lit(budget) / F.col("_t"), 9)
    weighed = raw.select(F.col("source").alias("_s"), "_t", weight.alias("weight"), repeats.alias("repeats"), F.round(weight * F.lit(budget)).alias("_quota"), F.ceil(F.col("_rows") / ROWS_PER_BLOCK).cast("long").alias("_blocks"))
    dealt = each.join(weighed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").where("repeats > 0")
    dealt = dealt.withColumn("pass", F.explode(F.sequence(F.lit(1), F.ceil("repeats").cast("int"))))
    dealt = dealt.withColumn("_h", F.xxhash64(F.lit("mix"), "pass", "doc_id", "source")).withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_blocks")))
    within = Window.partitionBy("source", "pass", "_b").orderBy("_h", "doc_id", "n_tokens")
    ordered = dealt.withColumn("_in", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    blocks = dealt.groupBy("source", "pass", "_b").agg(F.sum("n_tokens").alias("_n"))
    before = blocks.select(F.col("source").alias("_bs"), F.col("pass").alias("_bp"), F.col("_b").alias("_bb"), (F.sum("_n").over(Window.partitionBy("source", "pass").orderBy("_b")) - F.col("_n")).alias("_before"))
    placed = ordered.join(before, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("pass") == F.col("_bp")) & (F.col("_b") == F.col("_bb")))
    begins = (F.col("pass") - 1) * F.col("_t") + F.col("_before") + F.col("_in")
    return placed.select("doc_id", "source", "n_tokens", "weight", "repeats", "pass", begins.alias("_begins"), (begins / F.col("weight")).alias("position"), "_quota").where("_begins < _quota").drop("_begins", "_quota")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs, each as often as plan() deals its document out, with all their columns, whatever those are called. Nulls,
    empty texts, repeated rows and the empty table are treated as plan() says."""
    doc, source, times = (fresh(docs, x) for x in ("doc", "from", "times"))
    dealt = plan(docs, mix).groupBy("doc_id", "source").agg(F.count("*").cast("int").alias("n")).select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("n").alias(times))
    joined = docs.join(dealt, F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)))
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))
