"""Corpora in Parquet tables: documents, conversations, labels, events, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import SCORE_SEPARATOR, TAG_SEPARATOR, tokens
from seqloom.session import spread_small


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_small(table(spark, folder, "documents"), "doc_id")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spread_small(table(spark, folder, "conversations"), "conv_id", "turn")


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, line_no, lang, text)``, one row per line of a document."""
    docs = documents(spark, folder)
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def conversation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, turn, line_no, role, text)``"""
    talk = conversations(spark, folder)
    return talk.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def turn_pairs(spark: SparkSession, folder: str, first: str = "user", second: str = "assistant") -> DataFrame:
    """Parallel corpus ``(conv_id, turn, src, trg)``: a turn and the answer to it, whole texts."""
    talk = conversations(spark, folder)
    src = talk.where(F.col("role") == first).select("conv_id", "turn", F.col("text").alias("src"))
    trg = talk.where(F.col("role") == second).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("trg")
    )
    return src.join(trg, ["conv_id", "turn"])


def tagged_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)`` where every word carries the language of its document: ``word_lang``."""
    docs = documents(spark, folder)
    tagged = F.transform(tokens("text", lowercase=False), lambda w: F.concat(w, F.lit(TAG_SEPARATOR), F.col("lang")))
    return docs.select("doc_id", F.array_join(tagged, " ").alias("text"))


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return table(spark, folder, "labels").join(docs, "doc_id")


def feature_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)`` with ``label <tab> word_:_count …``, words in order of the alphabet."""
    words = labelled_documents(spark, folder).select("doc_id", "quality", F.explode_outer(tokens("text")).alias("tok"))
    words = words.where(F.col("tok").isNotNull())  # an inner generator would find the words once more, in a filter
    counts = words.groupBy("doc_id", "quality", "tok").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat("tok", F.lit(SCORE_SEPARATOR), F.col("n").cast("string"))
    lists = counts.groupBy("doc_id", "quality").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    text = F.concat(F.col("quality").cast("string"), F.lit("\t"), F.array_join("entries", " "))
    return lists.select("doc_id", text.alias("text"))


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)`` with ``label <tab> words``."""
    text = F.concat(F.col("toxic").cast("string"), F.lit("\t"), F.translate("text", "\n", " "))
    return labelled_documents(spark, folder).select("doc_id", text.alias("text"))
