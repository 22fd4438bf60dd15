"""Queries on lines, tokens and vocabularies of the document and conversation corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import LANGUAGE_MARKERS, append_eos, next_pairs, sentence_marks, tokens
from seqloom.operators import vocabulary as voc
from seqloom.plans import sql
from seqloom.sources.corpus import tokenize as add_tokens
from seqloom.sources.tables import conversation_lines, conversations, document_lines, documents, turn_pairs


def marked_lines(lines: DataFrame) -> DataFrame:
    """Token arrays between ``<s>`` and ``</s>``."""
    return lines.withColumn("toks", sentence_marks(tokens("text")))


def document_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model vocabulary of the documents.

    Line breaks are white space, so whole texts give the words in the order of the lines.
    """
    docs = documents(spark, folder)
    words = docs.select("doc_id", F.posexplode(tokens("text")).alias("pos", "tok"))
    return voc.fit_vocabulary(words, ("doc_id", "pos"), LANGUAGE_MARKERS)


def id_text(encoded: DataFrame, name: str = "ids") -> DataFrame:
    return encoded.withColumn(name, F.array_join(F.transform(name, lambda i: i.cast("string")), " "))


def scan_lines(spark, folder):
    return document_lines(spark, folder)


def tokenize(spark, folder):
    lines = add_tokens(document_lines(spark, folder))
    cased = add_tokens(lines, lowercase=False, name="cased")
    return cased.select(
        "doc_id",
        "line_no",
        F.size("toks").alias("n_tok"),
        F.array_join("cased", " ").alias("cased"),
        F.array_join(sentence_marks(F.col("toks")), " ").alias("marked"),
        F.array_join(append_eos(F.col("toks")), " ").alias("ended"),
    )


def next_token_pairs(spark, folder):
    lines = marked_lines(document_lines(spark, folder))
    return lines.select("doc_id", "line_no", F.posexplode(next_pairs(F.col("toks"))).alias("pos", "pair")).select(
        "doc_id", "line_no", "pos", "pair.prev", "pair.next"
    )


def token_counts(spark, folder):
    lines = marked_lines(document_lines(spark, folder))
    return voc.token_counts(lines.select(F.explode("toks").alias("tok")))


def vocab_fit(spark, folder):
    return document_vocabulary(spark, folder).select("tok", "id")


def vocab_size(spark, folder):
    return voc.vocabulary_size(document_vocabulary(spark, folder))


def vocab_shared(spark, folder):
    pairs = turn_pairs(spark, folder)
    sides = [
        pairs.select("conv_id", "turn", F.lit(i).alias("side"), F.posexplode(tokens(side)).alias("pos", "tok"))
        for i, side in enumerate(("src", "trg"))
    ]
    both = sides[0].unionByName(sides[1])
    # One INT for turn and side keeps the order within a conversation.
    place = (F.col("turn") * 2 + F.col("side")).cast("int")
    return voc.fit_vocabulary(both, ("conv_id", place, "pos"), LANGUAGE_MARKERS).select("tok", "id")


def encode_cut(spark, folder):
    lines = marked_lines(document_lines(spark, folder))
    return id_text(voc.encode_lines(lines, ["doc_id", "line_no"], document_vocabulary(spark, folder)))


def encode_known(spark, folder):
    lines = add_tokens(conversation_lines(spark, folder), tokenizer=lambda text: sentence_marks(tokens(text)))
    return id_text(voc.encode_lines(lines, ["conv_id", "turn", "line_no"], document_vocabulary(spark, folder)))


def talk_counts(spark, folder):
    talk = conversations(spark, folder)
    return voc.token_counts(talk.select(F.explode(tokens("text")).alias("tok")))


def oov_tokens(spark, folder):
    return voc.out_of_vocabulary(talk_counts(spark, folder), document_vocabulary(spark, folder))


def known_tokens(spark, folder):
    return voc.in_vocabulary(talk_counts(spark, folder), document_vocabulary(spark, folder))


def decode_ids(spark, folder):
    fitted = document_vocabulary(spark, folder)
    keys = ["doc_id", "line_no"]
    lines = document_lines(spark, folder).withColumn("toks", append_eos(tokens("text")))
    return voc.decode_lines(voc.encode_lines(lines, keys, fitted), keys, fitted)


QUERIES = {
    f.__name__: f
    for f in (
        scan_lines, tokenize, next_token_pairs, token_counts, vocab_fit, vocab_size, vocab_shared,
        encode_cut, encode_known, oov_tokens, known_tokens, decode_ids,
    )
}

_W = sql.words("text")
_TALK = f"""{sql.DOC_FIT},
talk_tokens AS (SELECT unnest({_W}) AS tok FROM conversations),
talk_counts AS (SELECT tok, count(*) AS n FROM talk_tokens GROUP BY tok)"""

SQL = {
    "scan_lines": f"WITH {sql.DOC_LINES} SELECT doc_id, lang, line_no, text FROM doc_lines",
    "tokenize": f"""WITH {sql.DOC_LINES}
SELECT doc_id, line_no, CAST(len({_W}) AS INT) AS n_tok,
  array_to_string({sql.words("text", lower=False)}, ' ') AS cased,
  array_to_string({sql.marked(_W)}, ' ') AS marked, array_to_string({sql.with_eos(_W)}, ' ') AS ended
FROM doc_lines""",
    "next_token_pairs": f"""WITH {sql.DOC_LINES}, {sql.pairs("p", "doc_lines", "doc_id, line_no", sql.marked(_W))}
SELECT doc_id, line_no, pos, prev, next FROM p""",
    "token_counts": f"""WITH {sql.DOC_LINES}, {sql.spread("t", "doc_lines", "doc_id", sql.marked(_W))}
SELECT tok, count(*) AS n FROM t GROUP BY tok""",
    "vocab_fit": f"{sql.DOC_FIT} SELECT tok, id FROM voc",
    "vocab_size": f"{sql.DOC_FIT} SELECT count(*) AS size FROM voc",
    "vocab_shared": f"""WITH prs AS (
  SELECT u.conv_id, u.turn, u.text AS src, a.text AS trg FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
both_sides AS (SELECT conv_id, turn, 0 AS side, src AS text FROM prs UNION ALL SELECT conv_id, turn, 1, trg FROM prs),
{sql.spread("t", "both_sides", "conv_id, turn, side", _W)},
{sql.vocabulary("voc", "t", "conv_id, turn, side, pos", sql.LANGUAGE)}
SELECT tok, id FROM voc""",
    "encode_cut": f"""{sql.DOC_FIT}, {sql.joined_ids("doc_lines", "doc_id, line_no", sql.marked(_W))}
SELECT doc_id, line_no, ids FROM encoded""",
    "encode_known": f"""{sql.DOC_FIT}, {sql.TALK_LINES},
{sql.joined_ids("talk_lines", "conv_id, turn, line_no", sql.marked(_W))}
SELECT conv_id, turn, line_no, ids FROM encoded""",
    "oov_tokens": f"{_TALK} SELECT tok, n FROM talk_counts WHERE tok NOT IN (SELECT tok FROM voc)",
    "known_tokens": f"{_TALK} SELECT tok, n FROM talk_counts WHERE tok IN (SELECT tok FROM voc)",
    "decode_ids": f"""{sql.DOC_FIT}
SELECT doc_id, line_no, string_agg(coalesce(voc.tok, '<UNK>'), ' ' ORDER BY pos) AS sentence
FROM doc_tokens LEFT JOIN voc USING (tok) GROUP BY doc_id, line_no""",
}
