"""Ratio-of-sums statistics with a delete-one block jackknife.

A statistic is a pair of columns; a site counts where both are there. Sites are summed per block map-side, so what is
shuffled is one row for each block and key; the second stage works on at most `blocks` rows a key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ratio

BLOCKS = 50


def assign_blocks(sites: DataFrame, order: str, blocks: int = BLOCKS, to: str = "blk") -> DataFrame:
    """Contiguous equal blocks over the order of the panel. For the site table only, which a genome bounds."""
    row = F.row_number().over(Window.orderBy(order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return sites.withColumn(to, F.floor(row * float(blocks) / n).cast("bigint"))


def f4(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a - b) * (c - d)


class Statistic(NamedTuple):
    """theta = sum(num) / sum(den)."""

    name: str
    num: Column
    den: Column


def dstat(name: str, w: Column, x: Column, y: Column, z: Column) -> Statistic:
    """Normalised D(w, x; y, z)."""
    return Statistic(name, (w - x) * (y - z), (w + x - 2 * w * x) * (y + z - 2 * y * z))


def f4_ratio(name: str, a: Column, o: Column, x: Column, b: Column, ref: Column) -> Statistic:
    """alpha = f4(a, o; x, b) / f4(a, o; ref, b)."""
    return Statistic(name, f4(a, o, x, b), f4(a, o, ref, b))


def mean(name: str, value: Column) -> Statistic:
    return Statistic(name, value, F.when(value.isNotNull(), F.lit(1.0)))


def block_sums(df: DataFrame, stats: list[Statistic], keys: list[str], block: str = "blk") -> DataFrame:
    """(keys, block, n_, d_ and c_ of each statistic) in one pass."""
    cols = []
    for s in stats:
        both = s.num.isNotNull() & s.den.isNotNull()
        cols += [F.sum(F.when(both, s.num)).alias(f"n_{s.name}"), F.sum(F.when(both, s.den)).alias(f"d_{s.name}"), F.count_if(both).alias(f"c_{s.name}")]
    return df.groupBy(*keys, block).agg(*cols)


def finalise(sums: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, theta_, se_, z_, sites_ and blocks_ of each statistic); SE is NULL with under two blocks."""
    aggs = []
    for s in names:
        used = F.col(f"c_{s}") > 0
        aggs += [F.sum(f"n_{s}").alias(f"n_{s}"), F.sum(f"d_{s}").alias(f"d_{s}"), F.sum(f"c_{s}").alias(f"sites_{s}")]
        aggs.append(F.collect_list(F.when(used, F.struct(F.col(f"n_{s}").alias("n"), F.col(f"d_{s}").alias("d")))).alias(f"b_{s}"))
    out = sums.groupBy(*keys).agg(*aggs)
    cols = list(keys)
    for s in names:
        out, own = _left_out(out, s)
        cols += own
    return out.select(*cols)


def _left_out(out: DataFrame, s: str) -> tuple[DataFrame, list]:
    """out with the delete-one values of statistic s, and the columns of its result."""
    n, d = F.col(f"n_{s}"), F.col(f"d_{s}")
    theta = ratio(n, d)
    left = F.transform(f"b_{s}", lambda b: ratio(n - b["n"], d - b["d"]))
    out = out.withColumn(f"l_{s}", F.filter(left, lambda x: x.isNotNull()))
    g, zero, m = F.size(f"l_{s}"), F.lit(0.0), F.col(f"m_{s}")
    out = out.withColumn(f"m_{s}", F.aggregate(f"l_{s}", zero, lambda a, x: a + x) / F.nullif(g, F.lit(0)))
    var = F.aggregate(f"l_{s}", zero, lambda a, x: a + (x - m) * (x - m)) / F.nullif(g, F.lit(0))
    out = out.withColumn(f"se_{s}", F.when(g > 1, F.sqrt((g - 1) * var)))
    return out, [theta.alias(f"theta_{s}"), f"se_{s}", ratio(theta, F.col(f"se_{s}")).alias(f"z_{s}"), f"sites_{s}", g.cast("bigint").alias(f"blocks_{s}")]


def jackknife(df: DataFrame, stats: list[Statistic], keys: list[str], block: str = "blk") -> DataFrame:
    return finalise(block_sums(df, stats, keys, block), [s.name for s in stats], keys)
