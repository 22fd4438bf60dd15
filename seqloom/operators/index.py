"""Row numbers over a whole table without a global window, and neighbours in hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_index(df: DataFrame, *order: Column | str, name: str = "row_index", start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, …`` in a total order.

    The rows are range-partitioned by the order and sorted inside each partition; the partition
    and the place in it are written with the rows. One prefix sum over the partition sizes (one
    row per partition) then gives every row its number. ``order`` must identify rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("_slot", F.monotonically_increasing_id()), name)
    part = F.shiftright("_slot", _SLOT_BITS).cast("int")
    sizes = dict(stored.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())  # a row per partition
    offsets, total = [], start
    for i in range(max(sizes, default=0) + 1):
        offsets.append(total)
        total += sizes.get(i, 0)
    starts = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<long>")  # folded to one constant
    place = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return stored.withColumn(name, F.get(starts, part) + place).drop("_slot")


def following(
    df: DataFrame, group: str, block: Column, order: list[str], value: str, name: str = "next", first: str | None = None
) -> DataFrame:
    """The next ``value`` inside each group, for groups of any size.

    ``block`` cuts a group into runs along ``order``. ``lead`` works inside a run; the last row of
    a run takes the first value of the next run from a table with one row per run. ``first`` names a
    column that marks the first row of a group.
    """
    cut = df.withColumn("_block", block)
    run = Window.partitionBy(group, "_block").orderBy(*order)
    inside = cut.withColumn(name, F.lead(value).over(run)).withColumn(
        "_last", F.lead(F.lit(True), 1, False).over(run) == F.lit(False)
    )
    if first:
        inside = inside.withColumn("_nth", F.row_number().over(run))
    # ``row_number() = 1`` is pruned before the shuffle, so this brings one row per run.
    firsts = cut.withColumn("_nth", F.row_number().over(run)).where(F.col("_nth") == 1)
    along = Window.partitionBy(group).orderBy("_block")
    runs = firsts.withColumn("_carry", F.lead(value).over(along)).withColumn("_opens", F.row_number().over(along) == 1)
    out = inside.join(runs.select(group, "_block", "_carry", "_opens"), [group, "_block"], "left").withColumn(
        name, F.when(F.col("_last"), F.col("_carry")).otherwise(F.col(name))
    )
    if first:
        out = out.withColumn(first, F.col("_opens") & (F.col("_nth") == 1))
    return out.drop("_block", "_last", "_carry", "_opens", "_nth")
