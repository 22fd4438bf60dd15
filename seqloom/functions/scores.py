"""Column expressions over class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.text import let

# Ignored target class, smoothing of hypothesis scores and of lexicon bias.
IGNORED = -1
HYPOTHESIS_EPS = 1e-6
LEXICON_EPS = 0.001


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k(scores: Column, k: int) -> Column:
    """Indices of the ``k`` largest scores, best first, lower index first on ties."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["i"])


def softmax(scores: Column) -> Column:
    """Exponentials divided by their sum, shifted by the maximum against overflow."""
    values = F.transform(scores, lambda x: x.cast("double"))
    return let(
        F.struct(values.alias("v"), F.array_max(values).alias("top")),
        lambda s: let(
            F.transform(s["v"], lambda x: F.exp(x - s["top"])),
            lambda p: let(
                F.struct(p.alias("v"), F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x).alias("total")),
                lambda q: F.transform(q["v"], lambda x: x / q["total"]),
            ),
        ),
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def interpolate(weight: Column, x: Column, y: Column) -> Column:
    """``σ(w)·x + (1 − σ(w))·y``"""
    s = sigmoid(weight)
    return s * x + (F.lit(1.0) - s) * y


def lexicon_bias(score: Column, lexicon_prob: Column) -> Column:
    return score + F.ln(F.lit(LEXICON_EPS) + lexicon_prob)


def brevity(score: Column, is_end: Column, discount: float) -> Column:
    """Scale the end token's score by ``1 − discount``; the rest stays, unnormalised."""
    return F.when(is_end, score * F.lit(1.0 - discount)).otherwise(score)


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def hypothesis_step(score: Column, prob: Column) -> Column:
    return score + F.ln(prob + F.lit(HYPOTHESIS_EPS))
