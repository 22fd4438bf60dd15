"""Connected components of a table of links, by rounds of distributed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node of the undirected links; the component is its smallest node.

    Each round links the larger neighbours of a node to its smallest one, then every node and its smaller
    neighbours to the smallest of them (two-phase contraction). A hot node is only ever joined as the one
    side of a join, whose other side adaptive execution splits, and the smallest neighbours are found by
    aggregates that combine before the shuffle. Rounds end when all links point to roots; their number
    grows with the logarithm of the component size. Each round is a written table. Self links are ignored.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    state = materialize(links.select(big.alias("u"), small.alias("v")).where("u <> v").distinct(), "links")
    while not state.join(state.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        # larger neighbours of u now point to the smallest node around u
        large = state.select(F.col("v").alias("u"), F.col("u").alias("x")).join(least, "u")
        state = materialize(large.select(F.col("x").alias("u"), F.col("low").alias("v")).distinct(), "large-star")
        low = state.groupBy("u").agg(F.min("v").alias("low"))
        small_star = state.join(low, "u")
        moved = small_star.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        state = materialize(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "small-star")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
