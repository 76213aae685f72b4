"""Quality rules as weak supervision: every rule votes or abstains, and expectation-maximisation weighs the votes.

All document work is DataFrame expressions. The votes of a document form one of 3^rules patterns; the only thing that leaves the
executors is the histogram of patterns, whose size is bounded by the number of rules and not by the data. EM runs on it: the
two classes have their own chance of each vote for each rule (its accuracy on good and on bad documents), and a document's
posterior probability of being good is again a DataFrame expression, a sum of weights by vote.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE_RE, cut, fresh, table, words

GOOD, NONE, BAD = 1, 0, -1


@dataclass(frozen=True)
class Rule:
    """Votes BAD where the measure is under bad_low or over bad_high, GOOD from good_low to good_high, else abstains."""

    name: str
    measure: str
    good_low: float = -math.inf
    good_high: float = math.inf
    bad_low: float = -math.inf
    bad_high: float = math.inf

    def vote(self):
        m = F.expr(self.measure)
        bad, good = (m < self.bad_low) | (m > self.bad_high), (m >= self.good_low) & (m <= self.good_high)
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


#: Measures are expressions over the base columns; shares are of words, or of characters in words. Bad bounds are tight and several
#: rules look at one kind of fault from two sides, so that a fault is told from an oddity by what else is wrong.
RULES = (
    Rule("length", "n_words", good_low=100, bad_low=60),
    Rule("word_length", "word_chars / greatest(n_words, 1)", good_low=3.5, good_high=6.2, bad_low=3, bad_high=6.8),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", good_high=0.03, bad_high=0.1),
    Rule("symbol_share", "n_symbols / greatest(word_chars, 1)", good_high=0.005, bad_high=0.02),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", good_high=0.08, bad_high=0.2),
    Rule("shouting", "n_shouts / greatest(n_words, 1)", good_high=0.05, bad_high=0.2),
    Rule("digits", "n_digits / greatest(word_chars, 1)", good_high=0.02, bad_high=0.06),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", good_high=0.2, bad_high=0.34),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", good_high=0.05, bad_high=0.15),
)
#: Where EM starts: chances of a vote, and share of good documents. They also count as PSEUDO documents of each class, so that a
#: small table's estimates stay near them and a large one's do not.
START = {GOOD: {GOOD: 0.9, NONE: 0.095, BAD: 0.005}, BAD: {GOOD: 0.75, NONE: 0.1, BAD: 0.15}}
START_GOOD, PSEUDO = 0.7, 100


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules are stated in, for each whole text.

    n_repeat_words: the 3-word windows of a text are sorted together with their places, equal neighbours are the repeated ones,
    and their places, sorted again, cover min(3, step to the last one) further words each. No step is quadratic in the text.
    """
    t = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    w = t.select("doc_id", "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE_RE)).alias("_l")).withColumn("n_words", F.size("_w"))
    at = lambda i: F.element_at("_w", i)
    g = w.withColumn("_g", F.when(F.col("n_words") >= 4, F.sort_array(F.transform(F.sequence(F.lit(1), F.col("n_words") - 2), lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("g"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get("_g", i)["g"] == x["g"], F.lit(False))
    p = g.withColumn("_p", F.sort_array(F.filter("_g", lambda x, i: same(x, i - 1) | same(x, i + 1))["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_p", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return p.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count("_t", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )


@dataclass
class VoteModel:
    """log_prior: log odds of good; weights: by rule and vote, log of chance among good over chance among bad."""

    log_prior: float
    weights: list[dict[int, float]]
    accuracies: list[dict[int, dict[int, float]]]

    @staticmethod
    def of(good: float, chances: list[dict[int, dict[int, float]]]) -> VoteModel:
        return VoteModel(math.log(good / (1 - good)), [{v: math.log(c[GOOD][v] / c[BAD][v]) for v in (GOOD, NONE, BAD)} for c in chances], chances)

    def log_odds(self, votes):
        return self.log_prior + sum(w[v] for w, v in zip(self.weights, votes, strict=True))


def fit(histogram: dict[tuple[int, ...], int], n_rules: int, rounds: int = 500, pseudo: float = PSEUDO) -> VoteModel:
    """EM over a histogram of vote patterns, until no chance moves by 1e-9. Chances are bounded away from 0 by the pseudo-counts."""
    chances, good, total = [{y: dict(START[y]) for y in (GOOD, BAD)} for _ in range(n_rules)], START_GOOD, sum(histogram.values())
    for _ in range(rounds):
        model = VoteModel.of(good, chances)
        counts, n_good = [{y: dict.fromkeys((GOOD, NONE, BAD), 0.0) for y in (GOOD, BAD)} for _ in range(n_rules)], 0.0
        for votes, n in histogram.items():
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(votes)))))
            n_good += n * p
            for c, v in zip(counts, votes, strict=True):
                c[GOOD][v] += n * p
                c[BAD][v] += n * (1 - p)
        of = {GOOD: n_good, BAD: total - n_good}
        before, chances = chances, [{y: {v: (c[y][v] + pseudo * START[y][v]) / (of[y] + pseudo) for v in c[y]} for y in c} for c in counts]
        good = (n_good + pseudo * START_GOOD) / (total + pseudo)
        if all(abs(b[y][v] - c[y][v]) < 1e-9 for b, c in zip(before, chances, strict=True) for y in c for v in c[y]):
            break
    return VoteModel.of(good, chances)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Per row of docs: the base measures, votes, posterior and verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior. Other columns of
    docs are not read. Null or empty text: no words, so base_failed and not kept. Null doc_id and repeated rows are judged like
    any other row. An empty table gives no rows.
    """
    votes = [r.vote().alias(f"_v{i}") for i, r in enumerate(rules)]
    voted = cut(base_measures(docs).select("*", *votes))
    names = [f"_v{i}" for i in range(len(rules))]
    histogram = {tuple(r[:-1]): r[-1] for r in voted.groupBy(*names).count().collect()}  # 3^rules rows at most
    model = fit(histogram, len(rules))
    odds = F.lit(model.log_prior)
    for name, w in zip(names, model.weights, strict=True):
        odds = odds + F.when(F.col(name) == GOOD, w[GOOD]).when(F.col(name) == BAD, w[BAD]).otherwise(w[NONE])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-odds))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (posterior >= least)).alias("kept"), posterior.alias("posterior"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever those are called. Rows of one doc_id are judged
    together: all must be kept; a null doc_id is one doc_id. Null and empty texts go; an empty table stays empty."""
    doc = fresh(docs, "doc")
    verdict = judge(docs).groupBy("doc_id").agg(F.min("kept").alias("kept")).where("kept").select(F.col("doc_id").alias(doc))
    return docs.join(verdict, F.col("doc_id").eqNullSafe(F.col(doc)), "left_semi")


def op5_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
