"""Consecutive numbers and running totals over an order, without bringing all rows to one task.

Rows are dealt to partitions by ranges of the order and sorted there; a row's number is its place in its partition plus
the rows of the partitions before, of which the driver sees one count each.
"""

from __future__ import annotations

from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: monotonically_increasing_id() has the partition in its upper bits.
_SHIFT = 33


def numbered(df: DataFrame, order: list[str | Column] | None, to: str = "i") -> DataFrame:
    """df with the numbers 0, 1, ... of its rows in `order` (None: as its partitions and rows stand).

    Rows that are equal in `order` get their numbers in no defined order, so it should name a key.
    """
    if order is not None:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _SHIFT)
    sizes = dict(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)), initial=0))
    number = F.get(F.lit(before).cast("array<bigint>"), part.cast("int")) + F.col("__at").bitwiseAND((1 << _SHIFT) - 1)
    return placed.withColumn(to, number).drop("__at")


def running(df: DataFrame, order: list[str | Column], value: str, to: str, kind: str = "sum") -> DataFrame:
    """df with the sum (or "min") of value over the rows up to each row of `order`, itself included.

    value has no NULLs. As with `numbered`, `order` should name a key; of each partition the driver sees one number.
    """
    over, combine = {"sum": (F.sum, add), "min": (F.min, min)}[kind]
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    placed = checkpointed(parts)
    totals = dict(placed.groupBy("__part").agg(over(value)).collect())  # one row a partition
    keys = sorted(totals)
    before = dict(zip(keys[1:], accumulate((totals[k] for k in keys[:-1]), combine)))
    here = over(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not before:
        return placed.withColumn(to, here).drop("__part")
    held = F.element_at(F.create_map(*(F.lit(v) for kv in before.items() for v in kv)), F.col("__part"))
    whole = here + F.coalesce(held, F.lit(0)) if kind == "sum" else F.least(here, held)
    return placed.withColumn(to, whole).drop("__part")
