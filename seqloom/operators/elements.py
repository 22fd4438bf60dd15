"""Arrays whose elements are looked up in a table of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.session import fits, materialize

UNIT_ELEMENTS = 1 << 20  # array elements that share a dictionary


def look_up_elements(rows: DataFrame, keys: list[str], array: str, table: DataFrame, default, name: str) -> DataFrame:
    """``keys, name``: ``array`` with each element replaced by its value in ``table``, which holds an element once.

    ``table`` has the element first and the value second. Elements that it does not hold, and nulls, become
    ``default``; a null array becomes an empty one.

    Rows are taken in units of about ``UNIT_ELEMENTS`` elements, each with a dictionary of its distinct elements. Only
    the dictionaries meet the table, an element once per unit however often it occurs; the rows, as numbers
    of dictionary places, then meet the values of their unit.
    """
    element, value = table.columns
    kind = table.schema[element].dataType
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("_unit", T.LongType()), T.StructField("_places", T.ArrayType(T.IntegerType())), T.StructField("_held", T.ArrayType(kind))])
    given = rows.select(*keys, F.coalesce(F.col(array), F.array().cast(T.ArrayType(kind))).alias("_array"))
    coded = materialize(given.mapInArrow(_coder(keys), schema), "coded")
    held = coded.where(F.col("_held").isNotNull()).select("_unit", F.posexplode("_held").alias("_place", element))
    held = held.join(F.broadcast(table) if fits(table) else table, element, "left")
    found = F.col(value) if default is None else F.coalesce(F.col(value), F.lit(default))
    values = held.select(F.col("_unit").alias("_of"), "_place", found.alias("_value")).groupBy("_of")
    lines = coded.where(F.col("_places").isNotNull()).drop("_held").groupBy("_unit")
    out = T.StructType([*fields, T.StructField(name, T.ArrayType(table.schema[value].dataType))])
    return lines.cogroup(values).applyInArrow(_filler(keys, name, default), out)


def _coder(keys: list[str]):
    """Rows as places in the dictionary of their unit, and the dictionaries."""

    def unit(number: int, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(pieces).combine_chunks()
        lists = rows["_array"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy()
        places = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), coded.indices.fill_null(-1).cast(pa.int32()))
        n, names = len(lists), [*keys, "_unit", "_places", "_held"]
        columns = [rows[k].combine_chunks() for k in keys]
        words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        yield from pa.table([*columns, np.full(n, number), places, pa.nulls(n, words.type)], names=names).to_batches()
        yield from pa.table([*[pa.nulls(1, c.type) for c in columns], np.full(1, number), pa.nulls(1, places.type), words], names=names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pieces, size = [], 0
        for batch in batches:
            ends = batch["_array"].offsets.to_numpy().astype(np.int64)
            borders = [0, *(np.flatnonzero(np.diff((ends[1:] - ends[0]) // UNIT_ELEMENTS)) + 1), batch.num_rows]
            for i, j in zip(borders[:-1], borders[1:]):
                pieces.append(batch.slice(i, j - i))
                size += ends[j] - ends[i]
                if size >= UNIT_ELEMENTS:
                    yield from unit(number, pieces)
                    number, pieces, size = number + 1, [], 0
        if pieces:
            yield from unit(number, pieces)

    return run


def _filler(keys: list[str], name: str, default):
    """The rows of a unit with the values of their places."""

    def run(rows: pa.Table, values: pa.Table) -> pa.Table:
        found = values["_value"].take(np.argsort(values["_place"].to_numpy())).combine_chunks()
        found = pa.concat_arrays([found, pa.array([default], found.type)])  # nulls have the place -1
        lists = rows["_places"].combine_chunks()
        places = lists.flatten().to_numpy()
        offsets = lists.offsets.to_numpy()
        filled = found.take(pa.array(np.where(places < 0, len(found) - 1, places)))
        return pa.table([*[rows[k] for k in keys], pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), filled)], names=[*keys, name])

    return run
