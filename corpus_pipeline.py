"""A training-data pipeline over ``documents``: each stage works on all that the one before kept, written as Parquet in between.

Odd cases, whatever stage they reach: a null text is an empty one; it is judged by the classifier, is a copy of nothing, holds no passage and no
secret, and is packed as its end id. Rows that share a doc_id, or have none, are judged each by their own text: of rows equal in doc_id and text one is
left, and of near copies the row with the least doc_id, then the least hash of its text. Very long texts are worked on whole, in blocks of their own. Columns
of any name pass through all stages but the last, which returns places. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, near_dedup, packing, quality_classifier, secrets
from tessella.llm.common import materialize, table
from tessella.llm.tokens import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return quality_classifier.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document with the least doc_id (5-word shingles, similarity 0.8)."""
    return near_dedup.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets that are not widely copied examples."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", good), ("near-dedup", distinct), ("decontamination", clean), ("secret scans", safe), ("best-fit packing", packed)]

#: The fitted classifier and the tokenizer have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
