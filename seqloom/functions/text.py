"""Column expressions over text lines and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker tokens and the separators of the file formats.
UNK = "<UNK>"
EOS = "<EOS>"
PAD = "{*}"
BOS = "<s>"
END = "</s>"
TAG_SEPARATOR = "_"
SCORE_SEPARATOR = "_:_"

# The markers each kind of vocabulary starts with, in id order.
TRANSLATION_MARKERS = (UNK, EOS, PAD)
TAG_MARKERS = (EOS, PAD)
LANGUAGE_MARKERS = (UNK, EOS, PAD, BOS, END)

# (?U) covers Unicode spaces; \x1c-\x1f are separators that it leaves out.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column | str, lowercase: bool = True) -> Column:
    """Words of a line: split at any Unicode white space, without empty strings."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(text) if lowercase else text, _SPACE), "")  # compiled, unlike a lambda


def sentence_marks(words: Column) -> Column:
    """``<s> words </s>``"""
    return F.concat(F.array(F.lit(BOS)), words, F.array(F.lit(END)))


def append_eos(words: Column) -> Column:
    return F.concat(words, F.array(F.lit(EOS)))


def next_pairs(words: Column, first: str = "prev", second: str = "next") -> Column:
    """Array of (word, following word); feed it to ``inline``."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, 1, n).alias(first), F.slice(words, 2, n).alias(second))


def pad_to(ids: Column, width: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), (width - F.size(ids)).cast("int")))


def until(words: Column, stop: str | int, inclusive: bool = False) -> Column:
    """The part before (or up to) the first ``stop``; everything when it does not occur."""
    at = F.array_position(words, F.lit(stop)).cast("int")
    keep = at if inclusive else at - 1
    return F.when(at > 0, F.slice(words, 1, keep)).otherwise(words)


def sequence_key(first: Column | str, *rest: Column | str) -> Column:
    """One exact number that sorts like the given non-negative parts, at most three.

    A number, unlike a struct, can be the buffer of a hash aggregate, so ``min`` over it needs
    no sort. The first part may be any BIGINT, the others are INT and share one BIGINT.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in (first, *rest)]
    low = F.lit(0).cast("long")
    for part in cols[1:]:
        low = F.shiftleft(low, 31) + part.cast("int")
    return cols[0].cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + low.cast("decimal(19,0)")


def sequence_low(key: Column) -> Column:
    """The last part of a key of two parts."""
    return F.pmod(key, F.lit(2**62).cast("decimal(19,0)")).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def bag(words: Column) -> Column:
    """Distinct elements of one array with how often each occurs: ``[(key, n), …]``.

    In the sorted array an element's count is the distance to the next distinct one.
    """
    return let(
        F.array_sort(words),
        lambda a: let(
            F.struct(a.alias("a"), F.array_distinct(a).alias("d")),
            lambda s: F.transform(
                s["d"],
                lambda w, i: F.struct(
                    w.alias("key"),
                    (
                        F.coalesce(F.array_position(s["a"], F.get(s["d"], i + 1)), F.size(s["a"]) + 1)
                        - F.array_position(s["a"], w)
                    ).alias("n"),
                ),
            ),
        ),
    )


def places(words: Column) -> Column:
    """Distinct elements of one array with their positions from 0: ``[(key, at), …]``."""
    spots = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return let(
        spots,
        lambda s: F.transform(
            F.array_distinct(s["w"]),
            lambda w: F.struct(
                w.alias("key"), F.filter(s, lambda x: x["w"] == w)["i"].alias("at")
            ),
        ),
    )
