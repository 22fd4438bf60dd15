"""Quality rules: a learned decision list over native text statistics.

Statistics and verdicts are Spark expressions. The list is learned from a bounded sample of labelled
rows by sequential covering: a rule grows condition by condition on one part of the sample, is pruned
on the other, and the documents it covers are set aside before the next rule.

Defined results: a null or empty text has no words, so it fails the base rule; rows of equal id or
text are judged alike and stay as many rows; without labelled rows no rule is learned and only the
base rule rejects; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SPACES, words_of

SYMBOLS = "#*$%&|<>"  # fixed values: the symbols counted as noise
SAMPLE_ROWS = 20_000  # bound of the labelled rows that one fit collects
FEATURES = (
    "n_words word_length symbol_rate dup_line_share repeat_share distinct_share upper_share digit_share "
    "mark_rate line_words"
).split()


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)).cast("double")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and the features that rules test. Helper columns start with ``_q_``."""
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.withColumns(
        {
            "_q_words": words_of(t),
            "_q_lines": F.filter(F.split(t, "\n", -1), lambda x: _without(x, SPACES) > 0),
        }
    )
    n = F.size("_q_words")
    w = F.col("_q_words")
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    second = first.withColumn("_q_grams", F.when(n >= 3, windows).otherwise(F.array().cast("array<long>")))
    grams = F.col("_q_grams")
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    # Only texts that repeat a window pay for a sort, which brings equal windows together.
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    third = second.withColumn("_q_sorted", F.when(repeats, placed))
    s = F.col("_q_sorted")

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get(s, k - 1)["g"], F.get(s, k + 1)["g"]
        return F.coalesce(before == x["g"], F.lit(False)) | F.coalesce(after == x["g"], F.lit(False))

    covered = F.flatten(F.transform(F.filter(s, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    counted = third.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": _without(t, SPACES).cast("long"),
            "n_symbols": (F.length(t) - _without(t, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": F.when(s.isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long"),
            "_q_distinct": F.size(F.array_distinct(w)),
            "_q_upper": F.length(F.regexp_replace(t, "[^A-Z]", "")),
            "_q_digit": F.length(F.regexp_replace(t, "[^0-9]", "")),
            "_q_marks": F.length(t) - _without(t, "!?.,;:"),
            "_q_nlines": F.size("_q_lines"),
            # Filters on the counts refer to it too: no filter is moved below a numbering, so that the
            # counts are computed once and not once more inside the filter.
            "_q_row": F.monotonically_increasing_id(),
        }
    )
    return counted.withColumns(
        {
            "word_length": _share(F.col("word_chars"), F.col("n_words")),
            "symbol_rate": _share(F.col("n_symbols"), F.col("n_words")),
            "dup_line_share": _share(F.col("n_dup_lines"), F.col("_q_nlines")),
            "repeat_share": _share(F.col("n_repeat_words"), F.col("n_words")),
            "distinct_share": _share(F.col("_q_distinct"), F.col("n_words")),
            "upper_share": _share(F.col("_q_upper"), F.col("word_chars")),
            "digit_share": _share(F.col("_q_digit"), F.col("word_chars")),
            "mark_rate": _share(F.col("_q_marks"), F.col("n_words")),
            "line_words": _share(F.col("n_words"), F.col("_q_nlines")),
        }
    ).drop(*[c for c in ("words", "lines", "grams", "sorted", "distinct", "upper", "digit", "marks", "nlines")
             for c in [f"_q_{c}"]])


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)


@dataclass(frozen=True)
class Rule:
    """Reject where every condition ``feature >= bound`` (or ``<=``) holds."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float

    def expression(self) -> Column:
        tests = [F.col(f) >= b if op == ">=" else F.col(f) <= b for f, op, b in self.conditions]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out

    def holds(self, row: dict) -> bool:
        return all(row[f] >= b if op == ">=" else row[f] <= b for f, op, b in self.conditions)

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{f} {op} {b:.6g}" for f, op, b in self.conditions)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) covered rows to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _best_condition(rows: list[dict], p0: int, n0: int) -> tuple[float, tuple | None]:
    best, chosen = 0.0, None
    for feature in FEATURES:
        order = sorted(rows, key=lambda r: r[feature])
        p = n = 0
        for i, row in enumerate(order):  # rows up to here are <= the bound, the others are above
            p, n = p + row["bad"], n + 1 - row["bad"]
            if i + 1 == len(order) or order[i + 1][feature] == row[feature]:
                continue
            bound = (row[feature] + order[i + 1][feature]) / 2
            for op, a, b in (("<=", p, n), (">=", p0 - p, n0 - n)):
                if (g := _gain(a, b, p0, n0)) > best + 1e-9:
                    best, chosen = g, (feature, op, bound)
    return best, chosen


def learn(rows: list[dict], min_precision: float = 0.9, min_cover: int = 5, max_conditions: int = 4) -> list[Rule]:
    """An ordered list of rejecting rules. ``rows`` hold the features and ``bad`` (1 for poor quality).

    Two rows of three grow a rule, the third prunes it. A rule that keeps less than ``min_precision``
    on either part, or covers fewer than ``min_cover`` poor rows, ends the list.
    """
    left = list(rows)
    rules: list[Rule] = []
    while sum(r["bad"] for r in left) >= min_cover and len(rules) < 32:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        covered, conditions = grow, []
        while len(conditions) < max_conditions:
            p0 = sum(r["bad"] for r in covered)
            n0 = len(covered) - p0
            if not p0 or not n0:
                break
            gain, condition = _best_condition(covered, p0, n0)
            if condition is None:
                break
            conditions.append(condition)
            covered = [r for r in covered if Rule((condition,), 0).holds(r)]

        def worth(cs: list, on: list[dict]) -> tuple[float, int, int]:
            hit = [r["bad"] for r in on if Rule(tuple(cs), 0).holds(r)]
            p = sum(hit)
            return ((2 * p - len(hit)) / len(hit) if hit else -1.0), p, len(hit)

        while len(conditions) > 1 and worth(conditions[:-1], prune)[0] >= worth(conditions, prune)[0]:
            conditions.pop()
        if not conditions:
            break
        _, p, hit = worth(conditions, left)
        _, pp, hp = worth(conditions, prune)
        if p < min_cover or p < min_precision * hit or pp < min_precision * hp:
            break
        rules.append(Rule(tuple(conditions), p / hit))
        left = [r for r in left if not rules[-1].holds(r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects; otherwise keep."""
    out = None
    for rule in rules:
        out = F.when(rule.expression(), False) if out is None else out.when(rule.expression(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled documents, those of the smallest id hashes.

    An id with contradicting labels counts as poor. Labels of unknown documents are ignored.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_q_id"))
        .agg(F.min("quality").alias("_q_label"))
        .orderBy(F.xxhash64("_q_id"), "_q_id")
        .limit(sample_rows)
    )
    some = docs.select(F.col("doc_id").alias("_q_doc"), "text")
    joined = some.join(F.broadcast(chosen), F.col("_q_doc") == F.col("_q_id"))  # at most sample_rows rows
    # Rows that fail the base rule are rejected anyway; the list learns about the others.
    stated = statistics(joined).where(~base_failed() & (F.col("_q_row") >= 0)).select("_q_doc", (1 - F.col("_q_label")).alias("bad"), *FEATURES)
    ordered = stated.orderBy(F.xxhash64("_q_doc"), *FEATURES).limit(sample_rows)
    return learn([r.asDict() for r in ordered.collect()])  # bounded by sample_rows


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base rule and the learned list keep, with the columns they had."""
    rules = fit(docs, labels)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(c) for c in names]).alias("_q_own"), F.col("text").alias("text"))
    return judge(packed, rules).where("kept and _q_row >= 0").select("_q_own.*")
