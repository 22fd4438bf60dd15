"""A corpus from documents to packed sequences, stage by stage.

Each stage gets the rows that its predecessor kept, written as Parquet and read again. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import line_dedup, minhash, packing, quality, toxicity
from seqloom.llm.common import read
from seqloom.llm.queries import tokenizer
from seqloom.session import scratch_path

SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality.filter_documents(docs, read(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.filter_documents(docs, read(spark, sf_dir, "labels"))


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines the first occurrence stays."""
    return line_dedup.filter_documents(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents the one of the smallest id stays."""
    return minhash.filter_documents(docs, SHINGLE_WORDS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line_dedup", fuzzy_line_dedup),
    ("minhash", minhash_dedup),
    ("packing", best_fit_packing),
]

ORACLE_SQL = None  # the first stages learn models, which SQL cannot state


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
