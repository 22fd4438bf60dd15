"""Losses and checks over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scores import IGNORED


def target_range(target: Column, classes: int) -> Column:
    """True for a class id or the ignored label."""
    return ((target >= 0) & (target < classes)) | (target == IGNORED)


def checked_target(target: Column, classes: int) -> Column:
    """The target itself; the job fails on a value out of range."""
    message = F.concat(F.lit("target out of range: "), target.cast("string"))
    return F.when(target_range(target, classes), target).otherwise(F.raise_error(message).cast("int"))


def cross_entropy(rows: DataFrame, group: list[str], probs: str, target: str, normalize: bool = True) -> DataFrame:
    """``group, n_used, loss``: mean of −ln p[target]; ignored rows add nothing.

    With ``normalize`` the divisor is the rows that count, else all rows; it is never below 1.
    """
    used = F.col(target) != IGNORED
    nll = F.when(used, -F.ln(F.get(probs, F.col(target))))
    divisor = F.count_if(used) if normalize else F.count(F.lit(1))
    return rows.groupBy(*group).agg(
        F.count_if(used).alias("n_used"),
        (F.coalesce(F.sum(nll), F.lit(0.0)) / F.greatest(divisor, F.lit(1))).alias("loss"),
    )


def accuracy(rows: DataFrame, group: list[str], predicted: str, reference: str) -> DataFrame:
    hit = F.when(F.col(predicted) == F.col(reference), 1).otherwise(0)
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def nan_counts(rows: DataFrame, group: list[str], array: str) -> DataFrame:
    bad = F.size(F.filter(array, lambda x: F.isnan(x)))
    return rows.groupBy(*group).agg(F.sum(F.size(array)).alias("n_values"), F.sum(bad).alias("n_nan"))


def guard_nan(column: Column, message: str) -> Column:
    """The value itself; the job fails on NaN."""
    return F.when(F.isnan(column), F.raise_error(F.lit(message)).cast("double")).otherwise(column)
