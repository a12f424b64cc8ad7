"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame operations only.

Words and pairs of words are hashed to ``BUCKETS`` buckets. Two multinomials over the buckets are counted: one on the trusted target (labelled
good), one on the whole raw corpus. A text's score is the sum over its n-grams of log(target) - log(raw), divided by
their number. Every text has a verdict by the same fixed rule: kept if the base rules pass and the score is at least ``THRESHOLD``
(a text without n-grams has no score and fails the base rules anyway).

Counting explodes n-grams only into a partial aggregate of at most BUCKETS groups a task, so the shuffle is small and any word may be frequent.
The table of ratios is a scalar subquery with BUCKETS entries, whatever the size of the corpus. Texts are never shuffled unless
the trusted ids are more than ``TRUSTED`` (then they are joined by doc_id).

Null texts have no words. Repeated rows are judged each, rows without a doc_id too; labels of one doc_id count once. A very long text is one array of
words, sorted in the row. A score equal to the threshold is kept. Without trusted texts all ratios are zero and the base rules decide. An empty table
gives no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, table, text_of

BUCKETS, ORDERS, THRESHOLD = 16_384, (1, 2), -0.045
#: Trusted ids that may be broadcast (16 bytes each).
TRUSTED = 2_000_000
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "")


def buckets_of(w: Column, buckets: int, orders: tuple[int, ...]) -> Column:
    """The bucket of every n-gram of the words, for each order."""
    parts = []
    for n in orders:
        grams = w if n == 1 else F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        parts.append(_hashed(w, grams, n, buckets))
    return F.concat(*parts)


def _hashed(w: Column, grams: Column, n: int, buckets: int) -> Column:
    def one(x: Column, i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(n), x, *[F.get(w, i + k) for k in range(1, n)]), F.lit(buckets)).cast("int")

    return F.transform(grams, one)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """One row: array ``llr`` with log(target / raw) of each bucket, both with one added to each count."""
    ids = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")).distinct()
    side = F.broadcast(ids) if ids.count() <= TRUSTED else ids
    marked = docs.join(side, F.col("doc_id") == F.col("_id"), "left").select(F.coalesce("_good", F.lit(0)).alias("good"), words_of(text_of()).alias("w"))
    grams = marked.select("good", F.explode(buckets_of(F.col("w"), buckets, orders)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    rows = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "target", "raw"))).alias("c"), F.sum("target").alias("t"), F.sum("raw").alias("r"))
    ratio = F.transform("c", lambda x: F.log((x["target"] + 1) / (F.col("t") + buckets)) - F.log((x["raw"] + 1) / (F.col("r") + buckets)))
    return rows.select(F.when(F.col("t") > 0, ratio).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("llr"))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, w (the words) and the base counts of each text."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_without(x, SPACE)) > 0)
    t = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("_text"))
    t = t.select("doc_id", words_of(text).alias("w"), F.length(_without(text, SPACE)).cast("bigint").alias("word_chars"), (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint").alias("n_symbols"), lines.alias("_lines"))
    t = t.select("doc_id", "w", "word_chars", "n_symbols", F.size("w").cast("bigint").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"))
    # Windows by (hash, place), sorted: equal windows are neighbours, and their words are compared.
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    t = t.withColumn("_h", windows)
    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    t = t.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))

    def same(x: Column, y: Column) -> Column:
        both = x["h"] == y["h"]
        for k in range(3):
            both = both & (F.get("w", x["i"] + k) == F.get("w", y["i"] + k))
        return F.coalesce(both, F.lit(False))

    again = F.filter("_p", lambda x, k: same(x, F.get("_p", k - 1)) | same(x, F.get("_p", k + 1)))
    t = t.withColumn("_q", F.sort_array(F.transform(again, lambda x: x["i"].cast("bigint"))))
    # the words that a window covers before the next repeated one begins
    covered = F.aggregate(F.transform("_q", lambda x, k: F.coalesce(F.least(F.get("_q", k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return t.select("doc_id", "w", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): the base counts, score, base_failed and kept."""
    docs = keyed(docs, "doc_id", "text")
    llr = log_ratios(docs, trusted, buckets, orders).scalar()
    rows = base_rules(docs).withColumn("_llr", llr)
    b = rows.withColumn("_b", buckets_of(F.col("w"), buckets, orders))
    total = F.aggregate("_b", F.lit(0.0), lambda s, x: s + F.get("_llr", x))
    scored = b.withColumn("score", F.round(F.try_divide(total, F.size("_b")), 6))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and likelihood-ratio verdict of every document; trusted are those labelled as good."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
