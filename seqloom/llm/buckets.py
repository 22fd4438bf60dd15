"""Buckets of posted rows for blocked comparison inside sorted runs, with large buckets dealt into tiles.

A posting has a long ``key``; rows that share a key are compared with one another. Keys that a bounded
sample shows to hold more than ``limit`` rows are cut: their rows get one of ``c`` chunks by hash, and every
pair of chunks becomes a tile of at most two chunks, so that each pair of rows still meets in some tile. The
sample only decides where to cut; a key that it misses is one longer run, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.lookup import lookup
from seqloom.session import materialize

SAMPLE_ITEMS = 20_000  # items whose postings are counted to find large buckets
CHUNK_ROWS = 8_192


def in_runs(items: DataFrame, post: Callable[[DataFrame], DataFrame], by: str, n: int, limit: int = CHUNK_ROWS) -> tuple[DataFrame, bool]:
    """The postings ``post(items)`` of ``n`` items, sorted by ``key, tile, by`` and whole in their partitions; and
    whether buckets were cut, so that rows of one chunk meet in several tiles."""
    posted, cut = post(items).withColumn("tile", F.lit(0).cast("long")), False
    rate = -(-n // SAMPLE_ITEMS)
    if n > limit:
        sample = post(items.where(F.pmod(F.xxhash64(by, F.lit(1)), F.lit(rate)) == 0))
        seen = sample.groupBy("key").agg((F.count(F.lit(1)) * rate).alias("rows")).where(F.col("rows") > limit)
        hot = materialize(seen.select("key", F.ceil(F.col("rows") / limit).alias("chunks")), "hot")
        if not hot.isEmpty():
            marked = lookup(posted.drop("tile"), hot, ["key"])
            chunks = F.coalesce("chunks", F.lit(1))
            own = F.pmod(F.xxhash64(by, F.lit(2)), chunks)
            tiles = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda t: F.least(own, t) * chunks + F.greatest(own, t))
            posted, cut = marked.withColumn("tile", F.explode(tiles)).drop("chunks"), True
    return posted.repartition("key", "tile").sortWithinPartitions("key", "tile", by), cut


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches, cut between runs: the rows of runs of two and more, and the number of each row's run."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = _starts(table)
        cut = starts[-1] if len(starts) else 0
        if cut:
            yield from _shared(table.slice(0, cut), starts[:-1])
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield from _shared(held, _starts(held))


def _starts(table: pa.Table) -> np.ndarray:
    key, tile = table.column("key").to_numpy(), table.column("tile").to_numpy()
    if not len(key):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))


def _shared(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    sizes = np.diff(np.append(starts, table.num_rows))
    many = np.repeat(sizes > 1, sizes)
    if many.any():
        yield table.filter(pa.array(many)), np.repeat(np.arange(len(sizes)), sizes)[many]
