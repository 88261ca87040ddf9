"""A corpus pipeline: toxic documents, unknown languages, near copies and repeated passages go; the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import scratch, staged
from parley.llm.jaccard_join import one_per_group
from parley.llm.language_id import with_known_language
from parley.llm.packing import pack_documents
from parley.llm.substring_dedup import without_repeats
from parley.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from all labels but the held-out fold; documents that score 0.7 or more go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is a near guess (score below 0.3), go."""
    return with_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 or more of their 5-word shingles, directly or by others, the smallest id stays."""
    return one_per_group(docs, k=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; documents with nothing left go."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed document."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: Learned models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared scratch folder and read again."""
    folder = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), folder, name)
    return docs
