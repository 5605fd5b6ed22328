"""From raw documents to packed training windows, one operator after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.

In every stage null texts count as empty, texts of any length are read whole, null ids are ids like others
that lose against any number, and columns beside those named keep their values, whatever their names. An
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pinwatch.llm import exact, jaccard, packing, quality, substrings
from pinwatch.llm.encoders import vocabulary_path
from pinwatch.session import prepare, scratch_path, scratch_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified thresholds. Empty texts go; without labels that
    certify a cutoff only the base rules reject. Repeated rows are judged alike."""
    prepare(spark)
    return quality.passing_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows that also share it one."""
    prepare(spark)
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles, directly or through others, the one with the smallest id. Texts without
    words are linked with nothing and all stay; of rows with one id and text one stays."""
    prepare(spark)
    return jaccard.one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that occur more than once, repeated rows being copies of each other. A text
    that loses all its words stays as an empty one; ``n_chars`` follows the text."""
    prepare(spark)
    return substrings.without_repeated_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all windows of 1024 ids; an empty text is its closing id. Repeated rows are packed each for
    itself."""
    prepare(spark)
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram jaccard join", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packed),
]

#: Windows hold ids of a tokenizer, which SQL can't make.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stores on its way goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
