"""Queries on batches, orders, saved models, user scorers and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import tokens
from seqloom.operators import batching, model_store, tagger
from seqloom.operators import language_model as lm
from seqloom.operators.elements import look_up_elements
from seqloom.operators.index import dense_index
from seqloom.operators.scorer import score_batches
from seqloom.plans import sql
from seqloom.plans.features import document_contexts
from seqloom.plans.language import bigram_report, document_model, rounded_losses
from seqloom.plans.text import document_vocabulary, id_text, marked_lines
from seqloom.session import materialize, scratch_path
from seqloom.sources import model_dir
from seqloom.sources.tables import document_lines, documents
from seqloom.streaming.encode import metrics_table, observed, read_encoded, run_batches, run_encoder, table_stream

KEYS = ["doc_id", "line_no"]
BATCH = 64
SEED, EPOCH = 7, 2
WHOLE_TABLE = -1  # batch number of what was observed without a stream


def document_batches(spark, folder) -> DataFrame:
    lines = marked_lines(document_lines(spark, folder)).select(*KEYS, F.size("toks").alias("n_tok"))
    # Range partitioning reads its input twice; the lengths are small, the texts are not.
    return batching.length_batches(materialize(lines, "lengths"), "n_tok", KEYS, BATCH)


def length_batches(spark, folder):
    return document_batches(spark, folder).select(*KEYS, "n_tok", "row_index", "batch_id")


def running_progress(spark, folder):
    return batching.batch_progress(document_batches(spark, folder))


def wraparound_fill(spark, folder):
    lines = document_lines(spark, folder).select(*KEYS)
    return batching.fill_last_batch(dense_index(lines, *KEYS), BATCH).select(*KEYS, "row_index")


def seeded_shuffle(spark, folder):
    """Order of the batches in one epoch."""
    batches = document_batches(spark, folder).select("batch_id").distinct()
    return batching.seeded_order(batches, "batch_id", SEED, EPOCH)


def shuffled_batches(spark, folder):
    """Documents in random batches of one epoch."""
    docs = documents(spark, folder).select("doc_id")
    placed = batching.seeded_order(docs, "doc_id", SEED, EPOCH)
    return placed.select("doc_id", F.floor(F.col("place") / BATCH).alias("batch_id"))


def vocab_roundtrip(spark, folder):
    path = scratch_path(spark, "vocabulary")
    model_dir.write_vocabulary(document_vocabulary(spark, folder), path)
    return model_dir.read_vocabulary(spark, path)


def model_spec(model) -> dict:
    return {
        "model": "bigram",
        "lowercase": True,
        "weight": model.weight,
        "targets": int(model.targets),
        "types": int(model.types),
        "base_unseen": 1.0 / (model.targets + model.types),
    }


def spec_roundtrip(spark, folder):
    path = scratch_path(spark, "spec")
    model_dir.write_spec(model_dir.spec_rows(spark, model_spec(document_model(spark, folder))), path)
    read = model_dir.read_spec(spark, path)
    number = F.coalesce("float_value", F.col("int_value").cast("double"), F.col("bool_value").cast("int").cast("double"))
    return read.select("name", "type", number.alias("number"), F.coalesce("str_value", F.lit("")).alias("word"))


def model_roundtrip(spark, folder):
    """Two different epochs are saved and a third is broken off; the newest whole one is rebuilt from disk."""
    path = scratch_path(spark, "model")
    lines = marked_lines(document_lines(spark, folder))
    model_store.save(lm.train_lines(lines.where(F.col("lang") == "en"), KEYS, cut=3), path, 1)
    model_store.save(lm.train_lines(lines, KEYS), path, 2)
    model_store.save(lm.train_lines(lines, KEYS, cut=2), path, 3, commit=False)
    return bigram_report(model_store.load(spark, path))


def unigram_score(batch: pd.DataFrame) -> pd.DataFrame:
    """Log score of each line from the counts of its words; ``total`` is the same in every row."""
    score = [float(np.log(np.asarray(n) / t).sum()) for n, t in zip(batch["counts"], batch["total"])]
    return batch[KEYS].assign(score=score)


def score_with_udf(spark, folder):
    fitted = document_vocabulary(spark, folder)
    total = fitted.agg(F.sum("n")).first()[0]
    lines = document_lines(spark, folder).select(*KEYS, tokens("text").alias("toks"))
    # Words below the cut were seen once.
    counted = look_up_elements(lines, KEYS, "toks", fitted.select("tok", "n"), 1, "counts")
    rows = counted.withColumn("total", F.lit(total))
    scored = score_batches(rows, unigram_score, "doc_id long, line_no int, score double")
    return scored.withColumn("score", F.round("score", 4))


LINE_METRICS = {
    "n_lines": "count(1)",
    "n_blank": "count_if(size(toks) = 2)",
    "n_tokens": "sum(cast(size(toks) AS long))",
}


def streamed_lines(spark, folder) -> DataFrame:
    docs = table_stream(spark, folder, "documents")
    return marked_lines(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")))


def stream_encode(spark, folder):
    """Documents arrive as a file stream; every line is encoded with the fitted vocabulary."""
    out = scratch_path(spark, "encoded")
    fitted = document_vocabulary(spark, folder)
    run_encoder(streamed_lines(spark, folder), KEYS, fitted, out, scratch_path(spark, "stream"))
    return id_text(read_encoded(spark, out))


def stream_metrics(spark, folder):
    """What the stream's progress says of each micro-batch, beside the same metrics observed on the whole table."""
    fitted = document_vocabulary(spark, folder)
    paths = scratch_path(spark, "encoded"), scratch_path(spark, "stream")
    found = run_encoder(streamed_lines(spark, folder), KEYS, fitted, *paths, metrics=LINE_METRICS)
    whole, seen = observed(marked_lines(document_lines(spark, folder)), LINE_METRICS)
    whole.write.format("noop").mode("overwrite").save()
    names = list(LINE_METRICS)
    return metrics_table(spark, found | {WHOLE_TABLE: seen.get}, names)


def stream_tag(spark, folder):
    """Conversations arrive as a file stream and are tagged by one epoch of a saved tagger."""
    path, out = scratch_path(spark, "tagger"), scratch_path(spark, "tagged")
    model_store.save(model_store.Tagger(tagger.train_tagger(document_contexts(spark, folder))), path, 1)
    model = model_store.load(spark, path, 1)
    keys = ["conv_id", "turn"]
    talk = table_stream(spark, folder, "conversations").select(*keys, tokens("text", False).alias("words"))

    def tagged(batch: DataFrame) -> DataFrame:
        return tagger.predict(model.counts, tagger.with_context(batch, keys)).select(*keys, "pos", "word", "tag")

    run_batches(talk, tagged, out, scratch_path(spark, "stream"))
    return read_encoded(spark, out)


def stream_sentence_ppl(spark, folder):
    """Conversations arrive as a file stream and are scored by one epoch of a saved language model."""
    path, out = scratch_path(spark, "model"), scratch_path(spark, "scored")
    model_store.save(document_model(spark, folder), path, 1)
    model = model_store.load(spark, path, 1)
    keys = ["conv_id", "turn", "line_no"]
    talk = table_stream(spark, folder, "conversations")
    lines = talk.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    run_batches(marked_lines(lines), lambda batch: lm.sentence_loss(model, lm.pair_rows(batch, keys), keys), out, scratch_path(spark, "stream"))
    return rounded_losses(read_encoded(spark, out))


QUERIES = {
    f.__name__: f
    for f in (
        length_batches, running_progress, wraparound_fill, seeded_shuffle, shuffled_batches, vocab_roundtrip,
        spec_roundtrip, model_roundtrip, score_with_udf, stream_encode, stream_metrics, stream_tag, stream_sentence_ppl,
    )
}

_W = sql.marked(sql.words("text"))
_BATCHES = f"""WITH {sql.DOC_LINES},
lengths AS (SELECT doc_id, line_no, CAST(len({_W}) AS INT) AS n_tok FROM doc_lines),
placed AS (SELECT *, row_number() OVER (ORDER BY n_tok DESC, doc_id, line_no) - 1 AS row_index FROM lengths),
batches AS (SELECT *, row_index // {BATCH} AS batch_id FROM placed)"""


def _shuffled(rows: str, key: str) -> str:
    hashed = f"md5('{SEED}:{EPOCH}:' || CAST({key} AS VARCHAR))"
    return f"SELECT {key}, row_number() OVER (ORDER BY {hashed}, {key}) - 1 AS place FROM {rows}"


def _sql() -> dict[str, str]:
    from seqloom.plans import features, language, text

    pairs = sql.pairs("prs", "doc_lines", "doc_id, line_no, lang", _W)
    model = f"WITH {sql.DOC_LINES}, {pairs}, {sql.bigram_model('prs', 'doc_id, line_no, pos')}"

    def row(name: str, kind: str, number: str, word: str = "") -> str:
        return f"SELECT '{name}' AS name, '{kind}' AS type, CAST({number} AS DOUBLE) AS number, '{word}' AS word FROM size"

    spec = " UNION ALL ".join([
        row("model", "str", "NULL", "bigram"),
        row("lowercase", "bool", "1"),
        row("weight", "float", "0.7"),
        row("targets", "int", "total"),
        row("types", "int", "types"),
        row("base_unseen", "float", "1.0 / CAST(total + types AS DOUBLE)"),
    ])
    return {
        "length_batches": f"{_BATCHES} SELECT doc_id, line_no, n_tok, row_index, batch_id FROM batches",
        "running_progress": f"""{_BATCHES}
SELECT batch_id, n, CAST(sum(n) OVER (ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
FROM (SELECT batch_id, count(*) AS n FROM batches GROUP BY batch_id)""",
        "wraparound_fill": f"""WITH {sql.DOC_LINES},
placed AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS row_index FROM doc_lines),
total AS (SELECT count(*) AS n FROM placed)
SELECT * FROM placed UNION ALL
SELECT doc_id, line_no, row_index + n FROM placed, total WHERE row_index < ({BATCH} - n % {BATCH}) % {BATCH}""",
        "seeded_shuffle": f"{_BATCHES} " + _shuffled("(SELECT DISTINCT batch_id FROM batches)", "batch_id"),
        "shuffled_batches": f"SELECT doc_id, place // {BATCH} AS batch_id FROM ({_shuffled('documents', 'doc_id')})",
        "vocab_roundtrip": text.SQL["vocab_fit"],
        "spec_roundtrip": f"{model} {spec}",
        "model_roundtrip": language.SQL["lm_train"],
        "score_with_udf": f"""{sql.DOC_FIT},
counts AS (SELECT tok, count(*) AS n FROM doc_tokens GROUP BY tok HAVING count(*) > 1)
SELECT doc_id, line_no, round(sum(ln(coalesce(n, 1) / (SELECT CAST(sum(n) AS DOUBLE) FROM counts))), 4) AS score
FROM doc_tokens LEFT JOIN counts USING (tok) GROUP BY doc_id, line_no""",
        "stream_encode": text.SQL["encode_cut"],
        "stream_metrics": f"""WITH {sql.DOC_LINES},
lines AS (SELECT len({_W}) AS n FROM doc_lines)
SELECT batch, count(*) AS n_lines, count(*) FILTER (WHERE n = 2) AS n_blank, CAST(sum(n) AS BIGINT) AS n_tokens
FROM lines, (VALUES (CAST(0 AS BIGINT)), ({WHOLE_TABLE})) AS b(batch) GROUP BY batch""",
        "stream_tag": features.SQL["tag_predict"],
        "stream_sentence_ppl": language.SQL["sentence_ppl"],
    }


SQL = _sql()
