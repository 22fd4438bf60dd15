"""The registered queries of this subpackage, each over its whole tables, and SQL where it can state them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import (
    ann,
    bpe,
    language_model,
    line_dedup,
    minhash,
    packing,
    quality,
    simhash,
    spelling,
    toxicity,
    url_filter,
    warc,
    whitening,
)
from seqloom.llm.common import fold, read


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; ``SEQLOOM_TOKENIZERS`` may name another folder."""
    folder = os.environ.get("SEQLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), 4)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", predicted)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, read(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(docs, rules).select("doc_id", *counts, "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.archive_round_trip(read(spark, sf_dir, "pages")).select(*columns)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_nearest_neighbours,
        op3_best_fit_packing,
        op4_url_filter,
        op5_bpe,
        op6_minhash,
        op7_language_model,
        op8_toxicity,
        op9_quality_rules,
        op10_warc,
        op11_whitening,
        op12_spelling_variants,
        op13_simhash,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])
    END) AS shingles FROM w
),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""

OP10_SQL = """
WITH h AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h),
b AS (
    SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
        lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM f
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        (1 + 16 * bits[5 * j + 1]::INT + 8 * bits[5 * j + 2]::INT + 4 * bits[5 * j + 3]::INT
        + 2 * bits[5 * j + 4]::INT + bits[5 * j + 5]::INT)]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

SQL = {"op6_minhash": OP6_SQL, "op10_warc": OP10_SQL}
