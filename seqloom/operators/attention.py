"""Dot-product attention over groups of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.softmax import group_softmax


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def attend(vectors: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Add ``weight``: softmax of the dot product with the group's first vector."""
    firsts = vectors.groupBy(group).agg(F.min(key).alias(key))
    queries = vectors.join(firsts, [group, key], "left_semi").select(group, F.col(vector).alias("_query"))
    scored = vectors.join(queries, group).withColumn("_score", dot(F.col("_query"), F.col(vector)))
    return group_softmax(scored.drop("_query"), [group], "_score", "weight").drop("_score")


def pool(weighted: DataFrame, group: str, vector: str, width: int) -> DataFrame:
    """``group, pooled``: weighted sum of the vectors, one partial sum per dimension."""
    sums = [F.sum(F.col("weight") * F.get(vector, F.lit(i)).cast("double")) for i in range(width)]
    return weighted.groupBy(group).agg(F.array(*sums).alias("pooled"))
