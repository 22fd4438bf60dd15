"""Tagger from context counts with back-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import BOS
from seqloom.operators.lookup import lookup
from seqloom.session import materialize

LOSS_EPS = 1e-6


def with_context(lines: DataFrame, keys: list[str], words: str = "words", tags: str | None = None) -> DataFrame:
    """``keys, pos, prev, word(, tag)`` from word arrays; the first word follows ``<s>``."""
    before = F.concat(F.array(F.lit(BOS)), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    columns = [before.alias("prev"), F.col(words).alias("word")] + ([F.col(tags).alias("tag")] if tags else [])
    spread = lines.where(F.size(words) > 0).select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("pos", "_w"))
    names = ["prev", "word"] + (["tag"] if tags else [])
    return spread.select(*keys, "pos", *[F.col(f"_w.{c}").alias(c) for c in names])


def train_tagger(contexts: DataFrame) -> DataFrame:
    """``prev, word, tag, n``; the shorter contexts are sums over this table.

    Rows lie in the order of their contexts in each file: neighbours share words, so the table and its shuffles
    compress well.
    """
    counted = contexts.groupBy("prev", "word", "tag").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted.sortWithinPartitions("prev", "word"), "tagger")


def back_off_counts(model: DataFrame) -> DataFrame:
    """All three levels in one table: ``level`` 2 = (prev, word), 1 = (word), 0 = no context."""
    two = model.select(F.lit(2).alias("level"), "prev", "word", "tag", "n")
    one = model.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    one = one.select(F.lit(1).alias("level"), F.lit(None).cast("string").alias("prev"), "word", "tag", "n")
    none = model.groupBy("tag").agg(F.sum("n").alias("n"))
    blank = F.lit(None).cast("string")
    none = none.select(F.lit(0).alias("level"), blank.alias("prev"), blank.alias("word"), "tag", "n")
    return two.unionByName(one).unionByName(none)


def _best(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("tag").alias("tag")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.tag").alias(name))


def resolve(model: DataFrame, wanted: DataFrame) -> DataFrame:
    """``prev, word, n, tag`` for distinct contexts: the longest context seen in training decides."""
    words = model.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    overall = (
        model.groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag").limit(1).select("tag").first()[0]
    )
    joined = wanted.join(_best(model, ["prev", "word"], "_two"), ["prev", "word"], "left").join(
        _best(words, ["word"], "_one"), "word", "left"
    )
    return joined.select("prev", "word", "n", F.coalesce("_two", "_one", F.lit(overall)).alias("tag"))


def predict(model: DataFrame, contexts: DataFrame) -> DataFrame:
    """Add ``tag`` to every row of ``contexts``; each distinct context is resolved once."""
    wanted = contexts.groupBy("prev", "word").agg(F.count(F.lit(1)).alias("n"))
    resolved = materialize(resolve(model, wanted), "resolved")
    return lookup(contexts, resolved, ["prev", "word"], how="inner").drop("n")


def tag_accuracy(model: DataFrame, contexts: DataFrame, group: list[str]) -> DataFrame:
    """``group, n_tok, accuracy, loss`` on tagged rows, from counts of distinct contexts; the loss is the mean
    negative log probability of the given tags, each its share in the longest context seen in training.

    The longest contexts are joined once, each with the list of its tags and their counts; one table of the shorter contexts
    has the best tag beside the total.
    """
    counted = contexts.groupBy(*group, "prev", "word", "tag").agg(F.count(F.lit(1)).alias("n"))
    seen = model.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    seen = materialize(seen, "words")
    tags = materialize(model.groupBy("tag").agg(F.sum("n").alias("n")), "tags")
    total = tags.agg(F.sum("n")).first()[0]
    overall = tags.orderBy(F.desc("n"), "tag").limit(1).select("tag").first()
    listed = model.groupBy("prev", "word").agg(F.collect_list(F.struct("tag", "n")).alias("_tags"))
    longest = counted.join(listed, ["prev", "word"], "left")
    best = F.array_min(F.transform("_tags", lambda x: F.struct((-x["n"]).alias("n"), x["tag"].alias("tag"))))["tag"]
    # A tag that the context does not have is a null, as from a join.
    own = F.filter("_tags", lambda x: x["tag"] == F.col("tag"))
    whole = F.aggregate("_tags", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    longest = longest.select(*group, "word", "tag", "n", best.alias("_tag2"), F.get(own, F.lit(0))["n"].alias("_n2"), whole.alias("_all2"))
    # The shorter context is asked for only where the longer one was never seen.
    known = materialize(longest, "longest")
    unseen = known.where(F.col("_all2").isNull())
    unseen = lookup(unseen, seen.withColumnRenamed("n", "_n1"), ["word", "tag"])
    unseen = lookup(unseen, materialize(_best_and_total(seen, ["word"], "1"), "best"), ["word"])
    unseen = lookup(unseen, tags.withColumnRenamed("n", "_n0"), ["tag"])
    share = lambda n, of: F.coalesce(n, F.lit(0)) / of
    columns = [*group, "n", "tag"]
    rows = known.where(F.col("_all2").isNotNull()).select(*columns, F.col("_tag2").alias("guess"), share("_n2", F.col("_all2")).alias("p"))
    least = F.when(F.col("_all1").isNotNull(), share("_n1", F.col("_all1"))).otherwise(share("_n0", F.lit(total)))
    guess = F.coalesce("_tag1", F.lit(overall[0] if overall else None))
    rows = rows.unionByName(unseen.select(*columns, guess.alias("guess"), least.alias("p")))
    hit = F.when(F.col("tag") == F.col("guess"), F.col("n")).otherwise(0)
    nll = F.col("n") * -F.ln(F.col("p") + F.lit(LOSS_EPS))
    return rows.groupBy(*group).agg(
        F.sum("n").alias("n_tok"), (F.sum(hit) / F.sum("n")).alias("accuracy"), (F.sum(nll) / F.sum("n")).alias("loss")
    )


def _best_and_total(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("tag").alias("tag")))
    found = counts.groupBy(*keys).agg(best.alias("_b"), F.sum("n").alias(f"_all{name}"))
    return found.select(*keys, F.col("_b.tag").alias(f"_tag{name}"), f"_all{name}")


class TaggerScorer:
    """The tagger as a :class:`~seqloom.operators.scorer.Scorer`: contexts with tags to train and evaluate on,
    contexts without to classify."""

    def __init__(self, group: list[str], counts: DataFrame | None = None) -> None:
        self.group, self.counts = group, counts

    def train(self, data: DataFrame) -> TaggerScorer:
        return TaggerScorer(self.group, train_tagger(data))

    def classify(self, data: DataFrame) -> DataFrame:
        return predict(self.counts, data)

    def evaluate(self, data: DataFrame) -> DataFrame:
        return tag_accuracy(self.counts, data, self.group)
