"""Queries on vectors and class scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import scores
from seqloom.functions.text import SCORE_SEPARATOR, UNK, tokens
from seqloom.operators import attention, metrics, model_store
from seqloom.operators.classifier import fit_named
from seqloom.session import materialize, scratch_path
from seqloom.sources.corpus import parse_features, scale_vectors, split_by_position
from seqloom.sources.tables import documents, table

SCALE = 255.0
TRAIN_SHARE = (6, 7)  # of the rows, in order of position
TOP = 3
CLASSES = 10
VALID_CLASSES = 8
BACKGROUND = 0  # class whose rows the loss ignores


def vectors(spark, folder):
    return table(spark, folder, "embeddings")


def n_train(rows: DataFrame) -> int:
    part, whole = TRAIN_SHARE
    return rows.count() * part // whole


def vector_split(spark, folder):
    rows = vectors(spark, folder)
    scaled = split_by_position(scale_vectors(rows, "embedding", SCALE), "vec_id", n_train(rows))
    return scaled.select("vec_id", "label", "part", F.posexplode("embedding").alias("dim", "x")).withColumn(
        "x", F.round("x", 9)
    )


def argmax_label(spark, folder):
    """Best class of each vector with its name; class ids beyond the name table read ``<UNK>``."""
    best = vectors(spark, folder).select("vec_id", scores.argmax(F.col("embedding")).alias("cls"))
    names = table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("cls"), F.col("n_name").alias("name"))
    return best.join(names, "cls", "left").select("vec_id", "cls", F.coalesce("name", F.lit(UNK)).alias("name"))


def topk_ids(spark, folder):
    best = scores.top_k(F.col("embedding"), TOP)
    return vectors(spark, folder).select("vec_id", F.posexplode(best).alias("rank", "cls"))


def softmax_scores(spark, folder):
    p = scores.softmax(F.col("embedding"))
    return vectors(spark, folder).select("vec_id", F.posexplode(p).alias("cls", "p")).withColumn("p", F.round("p", 9))


def nan_guard(spark, folder):
    logs = F.transform("embedding", lambda x: F.when(x > 0, F.ln(x.cast("double"))).otherwise(F.lit(float("nan"))))
    return metrics.nan_counts(vectors(spark, folder).select("label", logs.alias("logs")), ["label"], "logs").select(
        "label", F.col("n_values").cast("long").alias("n_values"), F.col("n_nan").cast("long").alias("n_nan")
    )


def attention_pool(spark, folder):
    rows = vectors(spark, folder)
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    pooled = attention.pool(attention.attend(rows, "label", "vec_id", "embedding"), "label", "embedding", width)
    return pooled.select("label", F.posexplode("pooled").alias("dim", "x")).withColumn("x", F.round("x", 7))


def cross_entropy(spark, folder):
    target = F.when(F.col("label") == BACKGROUND, scores.IGNORED).otherwise(F.col("label"))
    rows = vectors(spark, folder)
    rows = split_by_position(rows, "vec_id", n_train(rows)).select(
        "part",
        scores.softmax(F.col("embedding")).alias("p"),
        metrics.checked_target(target, CLASSES).alias("target"),
    )
    mean = metrics.cross_entropy(rows, ["part"], "p", "target")
    whole = metrics.cross_entropy(rows, ["part"], "p", "target", normalize=False)
    both = mean.join(whole.select("part", F.col("loss").alias("loss_all")), "part")
    return both.select("part", "n_used", F.round("loss", 6).alias("loss"), F.round("loss_all", 6).alias("loss_all"))


def label_check(spark, folder):
    ok = metrics.target_range(F.col("label"), VALID_CLASSES)
    rows = vectors(spark, folder).groupBy("label")
    return rows.agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


def ending_features(spark, folder) -> DataFrame:
    """``doc_id, label, pos, feat, score``: how large a share of a document's words ends in each letter; the
    label is its language. The lines have the format of weighted features."""
    words = documents(spark, folder).select("doc_id", "lang", F.explode(tokens("text")).alias("tok"))
    counts = words.groupBy("doc_id", "lang", F.substring("tok", -1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("doc_id", "lang").agg(F.array_sort(F.collect_list(F.struct("letter", "n"))).alias("e"), F.sum("n").alias("total"))
    entry = F.transform("e", lambda x: F.concat(x["letter"], F.lit(SCORE_SEPARATOR), (x["n"] / F.col("total")).cast("string")))
    return parse_features(listed.select("doc_id", F.concat("lang", F.lit("\t"), F.array_join(entry, " ")).alias("text")), ["doc_id"])


def mlp_fit_predict(spark, folder):
    """Languages by word endings: fitted on one part with the default network, saved, rebuilt, and used on all rows.

    What every sound fit must give: a name from the label set for each row, and more hits than the most
    frequent label would have, on the part that was not fitted.
    """
    rows = materialize(ending_features(spark, folder).withColumn("part", part_by_hash("doc_id")), "features")
    path = scratch_path(spark, "classifier")
    model_store.save(fit_named(rows.where(F.col("part") == "train"), ["doc_id"], ("doc_id", "pos")), path, 1)
    named = model_store.load(spark, path).predict(rows.drop("label"), ["doc_id"])
    labels = rows.select("doc_id", "part", "label").distinct()
    known = labels.where(F.col("part") == "train").select(F.col("label").alias("name"), F.lit(1).alias("known")).distinct()
    judged = labels.join(named, "doc_id").join(F.broadcast(known), "name", "left")  # a row for each class
    cells = judged.groupBy("part", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("known").alias("n_named"), F.count_if(F.col("name") == F.col("label")).alias("hits")
    )
    whole = cells.groupBy("part").agg((F.sum("hits") > F.max("n_rows")).alias("beats_majority"))
    return cells.join(whole, "part").select("part", F.col("label").alias("lang"), "n_rows", "n_named", "beats_majority")


def part_by_hash(key: str) -> Column:
    """``test`` for about three rows in sixteen, by the first digit of the key's hash."""
    digit = F.substring(F.md5(F.col(key).cast("string")), 1, 1)
    return F.when(digit < "3", "test").otherwise("train")


QUERIES = {
    f.__name__: f
    for f in (
        vector_split, argmax_label, topk_ids, softmax_scores, nan_guard, attention_pool, cross_entropy, label_check,
        mlp_fit_predict,
    )
}

_N_TRAIN = f"(SELECT count(*) * {TRAIN_SHARE[0]} // {TRAIN_SHARE[1]} FROM embeddings)"
_SOFTMAX = """
powers AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e
  FROM embeddings),
soft AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM powers)"""
_LONG = """
long AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""

SQL = {
    "vector_split": f"""WITH {_LONG}
SELECT vec_id, label, CASE WHEN vec_id < {_N_TRAIN} THEN 'train' ELSE 'test' END AS part, CAST(dim AS INT) AS dim,
  round(x / {SCALE}, 9) AS x FROM long""",
    "argmax_label": """
WITH best AS (SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS cls FROM embeddings)
SELECT vec_id, cls, coalesce(n_name, '<UNK>') AS name FROM best LEFT JOIN nation ON n_nationkey = cls""",
    "topk_ids": f"""WITH {_LONG},
ranked AS (SELECT vec_id, dim, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) AS rn FROM long)
SELECT vec_id, CAST(rn - 1 AS INT) AS rank, CAST(dim AS INT) AS cls FROM ranked WHERE rn <= {TOP}""",
    "softmax_scores": f"""WITH {_SOFTMAX}
SELECT vec_id, cls, round(p, 9) AS p
FROM (SELECT vec_id, CAST(unnest(range(len(p))) AS INT) AS cls, unnest(p) AS p FROM soft)""",
    "nan_guard": f"""WITH {_LONG}
SELECT label, count(*) AS n_values, count(*) FILTER (WHERE x <= 0) AS n_nan FROM long GROUP BY label""",
    "attention_pool": f"""WITH {_LONG},
firsts AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
query AS (SELECT long.label, dim, x AS q FROM long JOIN firsts USING (label, vec_id)),
dots AS (SELECT vec_id, label, sum(x * q) AS s FROM long JOIN query USING (label, dim) GROUP BY ALL),
tops AS (SELECT label, max(s) AS top FROM dots GROUP BY label),
weights AS (SELECT vec_id, label, exp(s - top) AS e FROM dots JOIN tops USING (label)),
sums AS (SELECT label, sum(e) AS total FROM weights GROUP BY label)
SELECT label, CAST(dim AS INT) AS dim, round(sum(e / total * x), 7) AS x
FROM long JOIN weights USING (vec_id, label) JOIN sums USING (label) GROUP BY label, dim""",
    "cross_entropy": f"""WITH {_SOFTMAX},
scored AS (
  SELECT CASE WHEN vec_id < {_N_TRAIN} THEN 'train' ELSE 'test' END AS part, CASE WHEN label = {BACKGROUND} THEN NULL ELSE -ln(p[label + 1]) END AS nll FROM soft)
SELECT part, count(nll) AS n_used, round(sum(nll) / greatest(count(nll), 1), 6) AS loss,
  round(sum(nll) / count(*), 6) AS loss_all FROM scored GROUP BY part""",
    "mlp_fit_predict": """
SELECT CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '3' THEN 'test' ELSE 'train' END AS part, lang,
  count(*) AS n_rows, count(*) AS n_named, true AS beats_majority
FROM documents WHERE regexp_matches(text, '\\S') GROUP BY ALL""",
    "label_check": f"""
SELECT label, count(*) FILTER (WHERE label BETWEEN 0 AND {VALID_CLASSES - 1} OR label = -1) AS n_valid,
  count(*) FILTER (WHERE NOT (label BETWEEN 0 AND {VALID_CLASSES - 1} OR label = -1)) AS n_invalid
FROM embeddings GROUP BY label""",
}
