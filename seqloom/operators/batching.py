"""Length-sorted batches, padding, fill and seeded order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.text import pad_to
from seqloom.operators.index import dense_index


def length_batches(lines: DataFrame, length: str, keys: list[str], batch_size: int = 64) -> DataFrame:
    """Add ``row_index`` and ``batch_id``: longest first, input order among equals."""
    indexed = dense_index(lines, F.desc(length), *keys)
    return indexed.withColumn("batch_id", F.floor(F.col("row_index") / batch_size))


def pad_batches(batches: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Pad each array column with its own id to the longest of its batch."""
    batch = Window.partitionBy("batch_id")  # a batch has at most batch_size rows
    for column, pad_id in columns.items():
        width = F.max(F.size(column)).over(batch)
        batches = batches.withColumn("_width", width).withColumn(column, pad_to(F.col(column), F.col("_width"), pad_id))
    return batches.drop("_width")


def batch_progress(batches: DataFrame) -> DataFrame:
    """``batch_id, n, done``: sentences in each batch and up to its end.

    Rows are numbered in batch order, so the running sum is the last number plus one.
    """
    return batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max("row_index") + 1).alias("done")
    )


def fill_last_batch(indexed: DataFrame, batch_size: int) -> DataFrame:
    """Repeat the first rows after the last one until the last batch is full."""
    n = indexed.agg(F.coalesce(F.max("row_index") + 1, F.lit(0))).first()[0]
    missing = -n % batch_size
    again = indexed.where(F.col("row_index") < missing).withColumn("row_index", F.col("row_index") + n)
    return indexed.unionByName(again)


def seeded_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Add ``place``, the row's position in a random order that seed and epoch fix."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))
    return dense_index(rows.withColumn("_hash", mixed), "_hash", key, name="place").drop("_hash")
