"""Document fingerprints: bottom-k sketches of word-shingle hashes, as DataFrame expressions.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles (all of them, if they are fewer).
The sketch of a union is the k smallest of the sketches' union, so sketches merge across parts of a document or corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, words

SHINGLE, K = 5, 256


def shingle_hashes(w: str, width: int = SHINGLE) -> Column:
    """Hashes of the shingles of a column of words; of the whole sequence if it is shorter, none if it is empty."""
    n = F.size(w)
    each = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(*[F.element_at(w, i + j if j else i) for j in range(width)]))
    return F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with the sketch of a text column; null counts as empty."""
    return df.withColumn("_w", words(F.col(text))).withColumn(out, bottom(shingle_hashes("_w"), k)).drop("_w")


def distinct_count(s: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else from how far the k smallest hashes reach."""
    reach = F.element_at(s, -1).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / reach)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two shingle sets; 1 for two empty ones."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(union, k) / distinct_count(a, k)))


def encode(s: Column) -> Column:
    """A sketch as text: base64 of its hashes, big-endian, 8 bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def merge_sketches(df: DataFrame, by: str, column: str, k: int = K) -> DataFrame:
    """One sketch per value of `by`. The k smallest are taken in each task before rows are moved."""
    each = df.select(by, F.explode(column).alias("_h")).distinct()
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def _search(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below value, by bisection."""
    b = F.array(*[F.lit(x).cast("bigint") for x in bounds])
    step = lambda a, _: F.when(a["lo"] >= a["hi"], a).otherwise(
        F.when(F.get(b, F.floor((a["lo"] + a["hi"]) / 2).cast("int")) < value, F.struct((F.floor((a["lo"] + a["hi"]) / 2) + 1).cast("int").alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), F.floor((a["lo"] + a["hi"]) / 2).cast("int").alias("hi")))
    )
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(len(bounds).bit_length())]), start, step, lambda a: a["lo"])


def with_next(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, object]:
    """Rows of docs with what is needed to look at the next row in descending doc_id, the last being followed by the first.

    The id range is cut into as many buckets as there are shuffle partitions. The row with the highest id of a bucket is also
    sent, as a guest, to the next bucket above, where it follows the lowest row; the highest of all also follows the lowest of
    all. So each bucket knows all its rows' successors, and no task sees more than a bucket. Only bucket bounds reach the driver.
    Returns the frame (with _guest marking rows to be left out at the end) and the window. Null ids come last; rows of one id
    are ordered by `columns`.
    """
    n = partitions(docs.sparkSession)
    shares = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * n).alias("b")).first()["b"] if shares else None
    bounds = sorted({x for x in found or []})
    bucketed = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(1 + _search(F.col("doc_id"), bounds) if bounds else F.lit(1)))
    heads = {r["_bucket"]: r["head"] for r in bucketed.groupBy("_bucket").agg(F.max("doc_id").alias("head")).collect()}
    filled, size = sorted(heads), len(bounds) + 2
    above = dict(zip(filled, filled[1:], strict=False))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"), F.lit(False).alias("wrap"))
    pick = lambda values, kind: F.get(F.array(*[F.lit(values.get(i)).cast(kind) for i in range(size)]), F.col("_bucket"))
    is_head = F.col("doc_id").eqNullSafe(pick(heads, "bigint"))
    up = F.struct(pick(above, "int").alias("bucket"), F.lit(True).alias("guest"), F.lit(False).alias("wrap"))
    around = F.struct(F.lit(filled[0] if filled else 0).alias("bucket"), F.lit(True).alias("guest"), F.lit(True).alias("wrap"))
    top = filled[-1] if filled else 0
    places = F.array(own, F.when(is_head & pick(above, "int").isNotNull(), up), F.when(is_head & (F.col("_bucket") == top), around))
    spread = bucketed.withColumn("_p", F.explode(F.filter(places, lambda x: x.isNotNull())))
    spread = spread.select("doc_id", *columns, F.col("_p.bucket").alias("_bucket"), F.col("_p.guest").alias("_guest"), F.col("_p.wrap").alias("_wrap"))
    return spread, Window.partitionBy("_bucket").orderBy("_wrap", F.col("doc_id").desc_nulls_last(), *columns)


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of whole texts, and of texts whose last third is replaced by the beginning of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimated
    distinct shingles); other columns of docs are not read. Null text: empty. Two texts without words are alike (1), one without
    and one with words are not (0). A null doc_id is the last in descending order. Of repeated rows each is the next of the one
    before. A table of one row is its own next. An empty table gives no rows.
    """
    t = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spread, w = with_next(t, ["text"])
    n = F.length("text")
    cut_at = F.floor(n / 3).cast("int")
    edited = spread.withColumn("_next", F.coalesce(F.lead("text").over(w), F.lit(""))).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut_at), F.substring(F.col("_next"), F.lit(1), cut_at))).drop("_next")
    both = sketch(sketch(edited, "text", "s", k), "edited", "e", k).withColumn("next_s", F.lead("s").over(w)).where(~F.col("_guest"))
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encode(F.col("s")).alias("fingerprint"),
        encode(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("next_s"), k).alias("near_next"),
        distinct_count(F.col("s"), k).alias("n_shingles"),
    )


def op2_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
