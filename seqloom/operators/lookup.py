"""Joins of a large table with a table that is unique on the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import BROADCAST_BYTES, fits

HOT_KEYS = 256  # keys that are spread at most
TRACKED = 10_000  # keys that the sketch follows; it misses none with more than a few shares of 1 / TRACKED
HOT_SHARE = 2_000  # a key is hot if it holds more than one row in so many
SALTS = 64


def lookup(facts: DataFrame, table: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``facts`` with ``table``, which holds each key once.

    A table of at most ``limit`` bytes is broadcast. For a larger one both sides are shuffled, with the
    hot keys of the facts spread over ``SALTS`` places: a frequent-items sketch, merged from all tasks, names
    them, whether the table holds them or not, and the table's rows for them, at most ``HOT_KEYS``, are
    repeated for each place. Null keys find nothing, and are spread like hot ones.
    """
    return lookups(facts, [(table, on)], how, limit)


def lookups(facts: DataFrame, tables: list[tuple[DataFrame, list[str]]], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``lookup`` in several tables by keys that ``facts`` has; one pass names the hot keys of all, before any join."""
    small = [fits(table, limit) for table, _ in tables]
    hot = iter(_hot_keys(facts, [on for (_, on), fit in zip(tables, small) if not fit]))
    for (table, on), fit in zip(tables, small):
        facts = facts.join(F.broadcast(table), on, how) if fit else _salted(facts, table, on, how, next(hot))
    return facts


def _salted(facts: DataFrame, table: DataFrame, on: list[str], how: str, hot: list[int]) -> DataFrame:
    wide = _among(on, hot)
    anywhere = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    missing = _missing(on)
    salted = facts.withColumn("_salt", F.when(missing | wide, anywhere).otherwise(F.lit(0)))
    places = F.when(wide, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = table.withColumn("_salt", F.explode(places))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def _missing(on: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(key).isNull() for key in on])


def hot_keys(facts: DataFrame, on: list[str]) -> list[int]:
    """Hashes of the keys that hold more than one of ``HOT_SHARE`` rows with a key, the most frequent first."""
    return _hot_keys(facts, [on])[0]


def _hot_keys(facts: DataFrame, ons: list[list[str]]) -> list[list[int]]:
    """``hot_keys`` for each of some lists of columns, in one pass."""
    if not ons:
        return []
    hashes = [F.when(~_missing(on), F.xxhash64(*on)).alias(f"k{i}") for i, on in enumerate(ons)]
    found = []
    for i in range(len(ons)):
        sketch = f"approx_top_k(k{i}, {HOT_KEYS}, {TRACKED}) FILTER (WHERE k{i} IS NOT NULL)"
        found += [F.count(f"k{i}").alias(f"n{i}"), F.expr(sketch).alias(f"top{i}")]
    row = facts.select(*hashes).agg(*found).first()
    return [[item["item"] for item in row[f"top{i}"] or [] if item["count"] * HOT_SHARE > row[f"n{i}"]] for i in range(len(ons))]


def _among(on: list[str], hashes: list[int]) -> Column:
    return F.xxhash64(*on).isin(hashes) if hashes else F.lit(False)
