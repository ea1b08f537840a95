"""Precision-weighted and rank aggregates; rows count where values are there and weights are positive."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ratio
from .ordinals import running


def weighted_mean(x: Column, w: Column) -> Column:
    ok = x.isNotNull() & (w > 0)
    return ratio(F.sum(F.when(ok, w * x)), F.sum(F.when(ok, w)))


def weighted_corr(x: Column, y: Column, w: Column, least: int = 10) -> Column:
    """Weighted Pearson correlation in one pass; NULL under `least` rows or without variance."""
    ok = x.isNotNull() & y.isNotNull() & (w > 0)
    s = lambda c: F.sum(F.when(ok, c))
    sw = s(w)
    mx, my = s(w * x) / sw, s(w * y) / sw
    cov = s(w * x * y) / sw - mx * my
    vx, vy = s(w * x * x) / sw - mx * mx, s(w * y * y) / sw - my * my
    return F.when((F.count_if(ok) >= least) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def weighted_variance(x: Column, w: Column) -> Column:
    m = weighted_mean(x, w)
    return weighted_mean(x * x, w) - m * m


def excess_variance(x: Column, se: Column, w: Column) -> Column:
    """Weighted variance less the weighted mean squared error, not under 0."""
    return F.greatest(F.lit(0.0), weighted_variance(x, w) - weighted_mean(se * se, w))


def within_z(df: DataFrame, value: str, se: str, by: str, to: str) -> DataFrame:
    """df with the z of value within its group: error and excess variance of the group against its weighted mean.

    Weights are 1 / max(se, 1e-4)^2. NULL for rows of no group.
    """
    x, e = F.col(value), F.col(se)
    w = 1 / F.pow(F.greatest(e, F.lit(1e-4)), 2)
    groups = df.filter(F.col(by).isNotNull()).groupBy(by).agg(weighted_mean(x, w).alias("__mu"), excess_variance(x, e, w).alias("__bio"))
    return df.join(groups, by, "left").withColumn(to, (x - F.col("__mu")) / F.sqrt(e * e + F.col("__bio"))).drop("__mu", "__bio")


def effective_n(w: Column) -> Column:
    return ratio(F.sum(w) * F.sum(w), F.sum(w * w))


def average_rank(df: DataFrame, value: str, to: str, by: list[str] | None = None) -> DataFrame:
    """df with average ranks of value (ties share the mean of their places) within groups `by`, which have no NULLs.

    Ranks come from counts per distinct value, summed over ranges of the values; a group is no task of its own.
    """
    by = by or []
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    per = running(per, [*by, value], "__c", "__t")
    start = F.lit(0)
    if by:
        per = per.join(per.groupBy(*by).agg(F.min(F.col("__t") - F.col("__c")).alias("__s")), by)
        start = F.col("__s")
    per = per.select(*by, value, (F.col("__t") - start - (F.col("__c") - 1) / 2).alias(to))
    return df.join(per, [*by, value])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_rank(average_rank(both, x, "__rx"), y, "__ry")
    return ranked.agg(F.corr("__rx", "__ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores (population deviation, 0 counts as 1); missing values take the median first."""
    stats = df.agg(*(F.percentile(c, 0.5).alias(f"__m{i}") for i, c in enumerate(columns)))
    filled = df.crossJoin(F.broadcast(stats)).select(*[c for c in df.columns if c not in columns], *(F.coalesce(c, f"__m{i}").alias(c) for i, c in enumerate(columns)))
    moments = filled.agg(*(x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"__a{i}"), F.stddev_pop(c).alias(f"__s{i}"))))
    scaled = [((F.col(c) - F.col(f"__a{i}")) / F.when(F.col(f"__s{i}") == 0, 1.0).otherwise(F.col(f"__s{i}"))).alias(c) for i, c in enumerate(columns)]
    return filled.crossJoin(F.broadcast(moments)).select(*[c for c in df.columns if c not in columns], *scaled)


def bonferroni_z(n: int, level: float = 0.05) -> float:
    """The two-sided threshold of |z| for n tests."""
    return NormalDist().inv_cdf(1 - level / (2 * max(n, 1)))


def two_sided_p(z: Column) -> Column:
    """Two-sided tail of the normal distribution: the series about 0 under |z| = 2.5, the continued fraction beyond.

    Each is fed within its own range only: whichever of them is evaluated first, |z| of 0 divides nothing.
    """
    a = F.abs(z)
    low, high = F.least(a, F.lit(2.5)), F.greatest(a, F.lit(2.5))
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    down = F.sequence(F.lit(80), F.lit(1), F.lit(-1))
    series = F.aggregate(down, F.lit(1.0), lambda s, i: 1 + s * low * low / (2 * i + 1))
    fraction = F.aggregate(down, high, lambda s, i: high + i / s)
    return F.when(a < 2.5, 1 - 2 * density * a * series).otherwise(2 * density / fraction)


def benjamini_hochberg(df: DataFrame, p: str, to: str = "q") -> DataFrame:
    """df with BH-adjusted p values: the running minimum from the largest p of p * n / rank. Rows without p go."""
    per = running(df.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("__c")), [p], "__c", "__r")
    n = per.agg(F.coalesce(F.max("__r"), F.lit(0))).first()[0]
    per = running(per.withColumn("__x", F.col(p) * n / F.col("__r")), [F.col(p).desc()], "__x", "__m", "min")
    return df.join(per.select(p, F.least(F.lit(1.0), "__m").alias(to)), p)
