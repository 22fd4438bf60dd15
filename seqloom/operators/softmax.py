"""Softmax over the rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_softmax(df: DataFrame, group: list[str], score: str, name: str) -> DataFrame:
    """Add the softmax of ``score`` within ``group``.

    Maximum and sum are aggregates with map-side combine, so a group may be of any size; a window
    would bring each group into one task.
    """
    tops = df.groupBy(*group).agg(F.max(score).alias("_top"))
    power = F.exp(F.col(score) - F.col("_top"))
    shifted = df.join(tops, group).withColumn("_power", power)
    totals = shifted.groupBy(*group).agg(F.sum("_power").alias("_total"))
    return (
        shifted.join(totals, group).withColumn(name, F.col("_power") / F.col("_total")).drop("_top", "_power", "_total")
    )
