"""Validation gates: declared tests of named estimates, judged in one pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Gate(NamedTuple):
    """Members whose values of a statistic lie between low and high (None: open), or rise in the order given.

    strict: bounds do not count as inside. absolute: of |value|. needed: members that have to fit (None: all).
    ordered: each member from the second on has to be above the one before by more than margin times that one's size.
    """

    name: str
    statistic: str
    members: tuple
    low: float | None = None
    high: float | None = None
    strict: bool = False
    absolute: bool = False
    needed: int | None = None
    ordered: bool = False
    margin: float = 0.0


SCHEMA = "gate string, statistic string, member {}, place int, low double, high double, strict boolean, absolute boolean, needed int, ordered boolean, margin double"


def gate_table(spark: SparkSession, gates: list[Gate], member_type: str = "string") -> DataFrame:
    """A row for each member of each gate."""
    rows = []
    for g in gates:
        needed = len(g.members) if g.needed is None else g.needed
        rows += [(g.name, g.statistic, m, k, g.low, g.high, g.strict, g.absolute, needed, g.ordered, float(g.margin)) for k, m in enumerate(g.members)]
    return spark.createDataFrame(rows, SCHEMA.format(member_type))


def judged(estimates: DataFrame, gates: DataFrame) -> DataFrame:
    """(gate, met, needed, least, most, passed) from estimates (member, statistic, value) and gate_table().

    A member without an estimate, or with a NULL or NaN one, does not fit; nor, in an order, does the one after it.
    least and most are of the members' values. Windows are by gate, over its members.
    """
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    rows = gates.join(estimates.withColumn("value", value), ["statistic", "member"], "left")
    x = F.when(F.col("absolute"), F.abs("value")).otherwise(F.col("value"))
    above = F.col("low").isNull() | F.when(F.col("strict"), x > F.col("low")).otherwise(x >= F.col("low"))
    below = F.col("high").isNull() | F.when(F.col("strict"), x < F.col("high")).otherwise(x <= F.col("high"))
    before = F.lag("value").over(Window.partitionBy("gate").orderBy("place"))
    # a member of size 0 counts as one of a millionth
    rises = (F.col("place") == 0) | (F.col("value") > before + F.col("margin") * F.greatest(F.abs(before), F.lit(1e-6)))
    fits = F.col("value").isNotNull() & F.when(F.col("ordered"), rises).otherwise(above & below)
    sums = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).groupBy("gate").agg(
        F.count_if("fits").alias("met"), F.max("needed").alias("needed"), F.min("value").alias("least"), F.max("value").alias("most"),
    )
    return sums.withColumn("passed", F.col("met") >= F.col("needed"))
