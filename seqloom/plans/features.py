"""Queries on tagged words, weighted features and labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import BOS, SCORE_SEPARATOR, TRANSLATION_MARKERS, tokens
from seqloom.operators import features as feat
from seqloom.operators import tagger
from seqloom.operators.vocabulary import fit_vocabulary
from seqloom.plans import sql
from seqloom.plans.text import id_text
from seqloom.session import materialize
from seqloom.sources import tables
from seqloom.sources.corpus import parse_features, parse_labelled_text, parse_tagged


def scan_tagged(spark, folder):
    return parse_tagged(tables.tagged_texts(spark, folder), ["doc_id"])


def document_contexts(spark, folder) -> DataFrame:
    """Every word of the documents with the word before it; its tag is the document's language."""
    docs = tables.documents(spark, folder).select("doc_id", "lang", tokens("text", False).alias("words"))
    tags = F.array_repeat("lang", F.size("words"))
    return tagger.with_context(docs.withColumn("tags", tags), ["doc_id", "lang"], tags="tags")


def tagger_train(spark, folder):
    return tagger.back_off_counts(tagger.train_tagger(document_contexts(spark, folder)))


def tag_predict(spark, folder):
    model = tagger.train_tagger(document_contexts(spark, folder))
    talk = tables.conversations(spark, folder)
    keys = ["conv_id", "turn"]
    asked = tagger.with_context(talk.select(*keys, tokens("text", False).alias("words")), keys)
    return tagger.predict(model, asked).select(*keys, "pos", "word", "tag")


def accuracy(spark, folder):
    """Accuracy and mean loss of the tagger on its own corpus, by the calls that a pluggable scorer has."""
    contexts = document_contexts(spark, folder)
    rows = tagger.TaggerScorer(["lang"]).train(contexts).evaluate(contexts)
    return rows.select("lang", "n_tok", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


def scan_features(spark, folder):
    parsed = parse_features(tables.feature_texts(spark, folder), ["doc_id"])
    return parsed.select("doc_id", "label", "feat", "score")


def feature_matrix(spark, folder):
    """Counts of words and of words with their capitals folded in share one feature name, so rows repeat."""
    cased = tables.labelled_documents(spark, folder)
    entry = F.transform(tokens("text", False), lambda w: F.concat(F.lower(w), F.lit(SCORE_SEPARATOR), F.lit("0.5")))
    text = F.concat(F.col("quality").cast("string"), F.lit("\t"), F.array_join(entry, " "))
    parsed = parse_features(cased.select("doc_id", text.alias("text")), ["doc_id"])
    return feat.feature_matrix(parsed, ["doc_id", "label"])


def feature_vocabulary(parsed: DataFrame) -> DataFrame:
    return fit_vocabulary(parsed, ("doc_id", "pos"), TRANSLATION_MARKERS, cut=None, token="feat")


def features_known(spark, folder):
    """Features of the benchmark texts, without labels, against the vocabulary of the documents."""
    entry = F.transform(tokens("text"), lambda w: F.concat(w, F.lit(SCORE_SEPARATOR), F.lit("1")))
    items = tables.table(spark, folder, "benchmark").select("item_id", F.array_join(entry, " ").alias("text"))
    matrix = feat.feature_matrix(parse_features(items, ["item_id"], labelled=False), ["item_id"])
    parsed = parse_features(tables.feature_texts(spark, folder), ["doc_id"])
    return feat.known_features(matrix, feature_vocabulary(parsed))


def scan_labelled_text(spark, folder):
    parsed = parse_labelled_text(tables.labelled_texts(spark, folder), ["doc_id"])
    return parsed.select("doc_id", "label", F.posexplode("toks").alias("pos", "word"))


def bag_of_words(spark, folder):
    parsed = parse_labelled_text(tables.labelled_texts(spark, folder), ["doc_id"])
    return feat.presence(parsed, ["doc_id", "label"])


def feature_vectors(spark, folder):
    """The weighted features of the labelled documents as sparse vectors, and their stored parts as text."""
    parsed = materialize(parse_features(tables.feature_texts(spark, folder), ["doc_id"]), "features")
    vocabulary = feature_vocabulary(parsed)
    known = feat.known_features(feat.feature_matrix(parsed, ["doc_id", "label"]), vocabulary)
    made = feat.feature_vectors(known, ["doc_id", "label"], vocabulary.count())
    parts = made.select("doc_id", "label", feat.vector_parts("features").alias("v"))
    counts = F.transform("v.values", lambda x: x.cast("long"))
    lists = parts.select("doc_id", "label", "v.size", "v.indices", counts.alias("weights"))
    return id_text(id_text(lists, "indices"), "weights")


QUERIES = {
    f.__name__: f
    for f in (
        scan_tagged, tagger_train, tag_predict, accuracy, scan_features, feature_matrix, features_known, feature_vectors,
        scan_labelled_text, bag_of_words,
    )
}

_CASED = sql.words("text", lower=False)
_CONTEXT = f"""
tagged AS (
  SELECT doc_id, lang, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word,
    unnest(list_concat(['{BOS}'], w[1:len(w) - 1])) AS prev
  FROM (SELECT doc_id, lang, {_CASED} AS w FROM documents)),
two AS (SELECT prev, word, lang AS tag, count(*) AS n FROM tagged GROUP BY ALL),
one AS (SELECT word, tag, CAST(sum(n) AS BIGINT) AS n FROM two GROUP BY ALL),
zero AS (SELECT tag, CAST(sum(n) AS BIGINT) AS n FROM two GROUP BY ALL),
best2 AS (SELECT prev, word, tag AS t2 FROM two QUALIFY row_number() OVER (PARTITION BY prev, word ORDER BY n DESC, tag) = 1),
best1 AS (SELECT word, tag AS t1 FROM one QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) = 1),
best0 AS (SELECT tag AS t0 FROM zero ORDER BY n DESC, tag LIMIT 1)"""
_LABELLED = "labelled AS (SELECT d.doc_id, quality, toxic, text FROM labels JOIN documents d USING (doc_id))"
_FEATS = f"""{_LABELLED},
feats AS (
  SELECT doc_id, CAST(quality AS VARCHAR) AS label, feat, CAST(count(*) AS DOUBLE) AS score
  FROM (SELECT doc_id, quality, unnest({sql.words("text")}) AS feat FROM labelled) GROUP BY ALL)"""
_BAG = f"""WITH {_LABELLED}
SELECT DISTINCT doc_id, CAST(CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS INT) AS label, unnest({_CASED}) AS feat
FROM labelled"""

_FEATURE_VOC = f"""
sorted_feats AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY encode(feat || '_:_' || CAST(CAST(score AS BIGINT) AS VARCHAR))) AS pos, feat AS tok
  FROM feats),
{sql.vocabulary("voc", "sorted_feats", "doc_id, pos", sql.TRANSLATION, cut=None)}"""

SQL = {
    "scan_tagged": f"""SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word, lang AS tag
FROM (SELECT doc_id, lang, {_CASED} AS w FROM documents)""",
    "tagger_train": f"""WITH {_CONTEXT}
SELECT CAST(2 AS INT) AS level, prev, word, tag, n FROM two UNION ALL
SELECT 1, NULL, word, tag, n FROM one UNION ALL SELECT 0, NULL, NULL, tag, n FROM zero""",
    "tag_predict": f"""WITH {_CONTEXT},
asked AS (
  SELECT conv_id, turn, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word,
    unnest(list_concat(['{BOS}'], w[1:len(w) - 1])) AS prev
  FROM (SELECT conv_id, turn, {_CASED} AS w FROM conversations))
SELECT conv_id, turn, pos, word, coalesce(t2, t1, t0) AS tag
FROM asked LEFT JOIN best2 USING (prev, word) LEFT JOIN best1 USING (word), best0""",
    "accuracy": f"""WITH {_CONTEXT}
SELECT lang, count(*) AS n_tok, round(avg(CASE WHEN t2 = lang THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(-ln(n / total + 1e-6)), 6) AS loss
FROM tagged JOIN best2 USING (prev, word)
JOIN (SELECT prev, word, tag AS lang, n, CAST(sum(n) OVER (PARTITION BY prev, word) AS DOUBLE) AS total FROM two) USING (prev, word, lang)
GROUP BY lang""",
    "scan_features": f"WITH {_FEATS} SELECT doc_id, label, feat, score FROM feats",
    "feature_matrix": f"WITH {_FEATS} SELECT doc_id, label, feat, score * 0.5 AS score FROM feats",
    "features_known": f"""WITH {_FEATS},
{_FEATURE_VOC},
items AS (SELECT item_id, unnest({sql.words("text")}) AS feat FROM benchmark)
SELECT item_id, feat, id, CAST(count(*) AS DOUBLE) AS score FROM items JOIN voc ON feat = tok GROUP BY ALL""",
    "feature_vectors": f"""WITH {_FEATS}, {_FEATURE_VOC}
SELECT doc_id, label, (SELECT CAST(count(*) AS INT) FROM voc) AS size, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS indices,
  string_agg(CAST(CAST(score AS BIGINT) AS VARCHAR), ' ' ORDER BY id) AS weights
FROM feats JOIN voc ON feat = tok GROUP BY doc_id, label""",
    "scan_labelled_text": f"""WITH {_LABELLED}
SELECT doc_id, label, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word
FROM (SELECT doc_id, CAST(CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS INT) AS label, {_CASED} AS w FROM labelled)""",
    "bag_of_words": _BAG,
}
