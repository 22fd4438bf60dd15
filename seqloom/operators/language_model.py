"""Interpolated bigram language model: counts, probabilities, losses.

Counts are taken before anything is joined, so hot words cost one row per partner, not one row
per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.scores import perplexity
from seqloom.functions.text import BOS, END, EOS, LANGUAGE_MARKERS, PAD, next_pairs, sequence_key
from seqloom.operators.lookup import lookup, lookups
from seqloom.operators.vocabulary import encode_lines, fit_vocabulary, number_vocabulary
from seqloom.session import materialize

UNK_ID, END_ID = LANGUAGE_MARKERS.index("<UNK>"), LANGUAGE_MARKERS.index(END)
BOS_ID = LANGUAGE_MARKERS.index(BOS)
NEVER_TARGET = (EOS, PAD, BOS)
RUN_IDS = 1 << 22  # pairs that are sorted and counted at a time
RUN_ROWS = 1 << 16  # rows of a batch that goes back to Spark


@dataclass
class BigramModel:
    vocabulary: DataFrame  # tok, id, n
    bigrams: DataFrame  # prev, next, n
    unigrams: DataFrame  # id, n_prev (as context), n_next (as target)
    targets: int  # number of predicted tokens
    types: int  # number of possible targets
    weight: float = 0.7

    def base(self, n_next: Column) -> Column:
        return (F.coalesce(n_next, F.lit(0)) + 1) / F.lit(float(self.targets + self.types))

    def smoothed(self, n: Column, n_prev: Column, n_next: Column) -> Column:
        """``λ·c(ab)/c(a) + (1−λ)·(c(b)+1)/(N+V)``; a context never seen leaves the base alone."""
        mixed = F.lit(self.weight) * F.coalesce(n, F.lit(0)) / n_prev + F.lit(1 - self.weight) * self.base(n_next)
        return F.when(F.coalesce(n_prev, F.lit(0)) > 0, mixed).otherwise(self.base(n_next))


def pair_rows(sentences: DataFrame, keys: list[str], words: str = "toks") -> DataFrame:
    """``keys, pos, prev, next``: every word with its follower."""
    zipped = next_pairs(F.col(words))
    return sentences.select(*keys, F.posexplode(zipped).alias("pos", "_pair")).select(
        *keys, "pos", F.col("_pair.prev").alias("prev"), F.col("_pair.next").alias("next")
    )


def train(pairs: DataFrame, seq: tuple[Column | str, ...], cut: int = 1, weight: float = 0.7) -> BigramModel:
    """Fit from ``(prev, next)`` occurrences that ``seq`` orders; one pass over the text."""
    raw = materialize(
        pairs.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"), F.min(sequence_key(*seq)).alias("first")),
        "pairs",
    )
    words = raw.groupBy(F.col("next").alias("tok")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    vocabulary = number_vocabulary(words, LANGUAGE_MARKERS, cut)
    numbered = to_ids(raw.select("prev", "next", "n"), vocabulary)
    bigrams = materialize(
        numbered.groupBy(F.col("prev_id").alias("prev"), F.col("next_id").alias("next")).agg(F.sum("n").alias("n")),
        "bigrams",
    )
    return _model(vocabulary, bigrams, weight)


def fit_words(sentences: DataFrame, keys: list[str], cut: int = 1, words: str = "toks") -> DataFrame:
    """The vocabulary of the predicted words of ``sentences``, in the order of ``keys``, at most two."""
    predicted = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    spread = sentences.select(*keys, F.posexplode(predicted).alias("pos", "tok"))
    return fit_vocabulary(spread, (*keys, "pos"), LANGUAGE_MARKERS, cut)


def encode(sentences: DataFrame, keys: list[str], vocabulary: DataFrame, words: str = "toks") -> DataFrame:
    """``keys, ids``; unknown words become ``<UNK>``."""
    return encode_lines(sentences, keys, vocabulary, UNK_ID, words)


def train_encoded(encoded: DataFrame, vocabulary: DataFrame, weight: float = 0.7) -> BigramModel:
    """What ``train`` gives, from ``ids`` of sentences: pairs are counted as numbers, and no pair meets the vocabulary.

    Pairs travel in runs sorted by their words, and the model's rows lie in that order in each file: neighbours share
    a word, so that shuffles and files of them compress well.
    """
    runs = encoded.select("ids").mapInArrow(_counted_runs(), "prev int, next int, n long")
    counted = runs.groupBy("prev", "next").agg(F.sum("n").alias("n"))
    return _model(vocabulary, materialize(counted.sortWithinPartitions("prev", "next"), "bigrams"), weight)


def _counted_runs():
    """The distinct pairs of about ``RUN_IDS`` ids at a time with their counts, in order."""

    def counted(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.unique(np.concatenate(codes), return_counts=True)
        columns = [(pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), n.astype(np.int64)]
        yield from pa.table(columns, names=["prev", "next", "n"]).to_batches(max_chunksize=RUN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            ids, ends = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
            follows = np.ones(max(len(ids) - 1, 0), dtype=bool)
            follows[ends[(ends > 0) & (ends < len(ids))] - 1] = False  # no pair across sentences
            held.append((ids[:-1] << 32 | ids[1:])[follows])
            size += len(held[-1])
            if size >= RUN_IDS:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    return run


def train_lines(sentences: DataFrame, keys: list[str], cut: int = 1, weight: float = 0.7, words: str = "toks") -> BigramModel:
    """``train`` for whole sentences that ``keys`` order."""
    vocabulary = fit_words(sentences, keys, cut, words)
    return train_encoded(encode(sentences, keys, vocabulary, words), vocabulary, weight)


def _model(vocabulary: DataFrame, bigrams: DataFrame, weight: float) -> BigramModel:
    sides = F.array(
        F.struct(F.col("prev").alias("id"), F.col("n").alias("as_prev"), F.lit(0).cast("long").alias("as_next")),
        F.struct(F.col("next").alias("id"), F.lit(0).cast("long").alias("as_prev"), F.col("n").alias("as_next")),
    )
    unigrams = materialize(
        bigrams.select(F.inline(sides)).groupBy("id").agg(F.sum("as_prev").alias("n_prev"), F.sum("as_next").alias("n_next")),
        "unigrams",
    )
    total = unigrams.agg(F.coalesce(F.sum("n_next"), F.lit(0))).first()[0]
    types = vocabulary.where(~F.col("tok").isin(*NEVER_TARGET)).count()
    return BigramModel(vocabulary, bigrams, unigrams, total, types, weight)


def to_ids(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``prev_id`` and ``next_id``; unknown words become ``<UNK>``."""
    sides = [(vocabulary.select(F.col("tok").alias(side), F.col("id").alias(f"{side}_id")), [side]) for side in ("prev", "next")]
    pairs = lookups(pairs, sides)
    return pairs.withColumns({c: F.coalesce(c, F.lit(UNK_ID)) for c in ("prev_id", "next_id")})


def with_probability(
    model: BigramModel,
    pairs: DataFrame,
    prev: str = "prev_id",
    following: str = "next_id",
    counted: str | None = None,
) -> DataFrame:
    """Add ``p`` to rows that hold a context id and a target id.

    ``counted`` names a column that already holds how often the pair was seen in training; without
    it the counts are joined.
    """
    before = model.unigrams.select(F.col("id").alias(prev), F.col("n_prev").alias("_n_prev"))
    after = model.unigrams.select(F.col("id").alias(following), F.col("n_next").alias("_n_next"))
    if counted is not None:
        out = pairs.withColumn("_n", F.col(counted))
    else:
        known = model.bigrams.select(F.col("prev").alias(prev), F.col("next").alias(following), F.col("n").alias("_n"))
        out = materialize(pairs.join(known, [prev, following], "left"), "counted")
    out = lookups(out, [(before, [prev]), (after, [following])])
    p = model.smoothed(F.col("_n"), F.col("_n_prev"), F.col("_n_next"))
    return out.withColumn("p", p).drop("_n", "_n_prev", "_n_next")


def bigram_table(model: BigramModel) -> DataFrame:
    """``prev, next, n, p`` with words in place of ids."""
    named = materialize(model.vocabulary.select("id", "tok").join(model.unigrams, "id", "left"), "named")
    before = named.select(F.col("id").alias("prev"), F.col("tok").alias("prev_tok"), "n_prev")
    after = named.select(F.col("id").alias("next"), F.col("tok").alias("next_tok"), "n_next")
    scored = lookups(model.bigrams, [(before, ["prev"]), (after, ["next"])])
    p = model.smoothed(F.col("n"), F.col("n_prev"), F.col("n_next"))
    return scored.select(F.col("prev_tok").alias("prev"), F.col("next_tok").alias("next"), "n", p.alias("p"))


def sentence_loss(model: BigramModel, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_tok, loss, ppl``: mean negative log probability of each sentence.

    Every distinct pair is scored once; the occurrences then take its loss.
    """
    distinct = pairs.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("_seen"))
    scored = materialize(
        with_probability(model, to_ids(distinct, model.vocabulary)).select("prev", "next", "_seen", (-F.ln("p")).alias("nll")),
        "scored",
    )
    rows = lookup(pairs.select(*keys, "prev", "next"), scored, ["prev", "next"], how="inner")
    loss = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tok"), F.avg("nll").alias("loss"))
    return loss.withColumn("ppl", perplexity(F.col("loss")))


def corpus_loss(model: BigramModel, pairs: DataFrame, group: list[str], share: Column) -> DataFrame:
    """Losses per group of sentences.

    ``loss`` is the mean over sentences of their mean loss, ``token_loss`` the mean over tokens.
    ``share`` is 1/length of the sentence a pair stands in: summed per distinct pair it carries
    the sentence mean through the aggregation, so no occurrence is joined with the model. Pairs of words
    or, if they are numbers, of ids.
    """
    counted = pairs.groupBy(*group, "prev", "next").agg(
        F.count(F.lit(1)).alias("_count"), F.sum(share).alias("_share")
    )
    if isinstance(pairs.schema["prev"].dataType, T.StringType):
        scored = with_probability(model, to_ids(counted, model.vocabulary))
    else:
        scored = with_probability(model, counted, "prev", "next")
    scored = scored.withColumn("nll", -F.ln("p"))
    return (
        scored.groupBy(*group)
        .agg(
            F.sum("_count").alias("n_tok"),
            (F.sum(F.col("_share") * F.col("nll")) / F.sum("_share")).alias("loss"),
            (F.sum(F.col("_count") * F.col("nll")) / F.sum("_count")).alias("token_loss"),
        )
        .withColumn("ppl", perplexity(F.col("loss")))
        .withColumn("token_ppl", perplexity(F.col("token_loss")))
    )
