"""A training corpus from raw documents: STAGES in order, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailsieve.llm import cotrain, packing, rules, simhash
from mailsieve.llm.bpe import vocabulary_path
from mailsieve.llm.common import remove, scratch, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts go; repeated rows are judged alike; an empty table stays empty."""
    small_batches(spark)
    return rules.filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier holds for good ones, as likely as not.

    It is fitted on the table documents as it was before any stage, since the rules leave no row that is labelled bad. Nulls in any
    column count as values; without labels of two classes there is a warning and every document stays.
    """
    small_batches(spark)
    return cotrain.filter_documents(docs, table(spark, sf_dir, "labels"), threshold=0.5, fit_on=table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    That with the smallest id stays (a null id is the largest); texts without words are copies of each other.
    """
    small_batches(spark)
    return simhash.dedupe(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of sequences of 2048 tokens; null and empty texts are a piece of one token."""
    small_batches(spark)
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("packing", pack)]
#: Model fitting, tokenising and linear programming are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; an empty table gives no pieces."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
