"""Segments along chromosomes: runs, gaps, a two-state Viterbi path and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the model: emission rates of the two states, length scale (cM), prior.
E0, E1, TAU_CM, PI1 = 0.085, 0.50, 25.0, 0.08


def gaps(df: DataFrame, keys: list[str], order: str, to: str = "gap") -> DataFrame:
    """df with the distance to the row before of the same key, not under 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(to, F.greatest(F.lit(0.0), F.col(order) - F.lag(order).over(w)))


def runs(df: DataFrame, keys: list[str], order: list[str], state: Column, position: str) -> DataFrame:
    """(keys, run, start, end, n) of maximal runs of rows where state is 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__s", state.cast("int"))
    rows = rows.withColumn("__new", (F.col("__s") != F.coalesce(F.lag("__s").over(w), F.lit(-1))).cast("int"))
    rows = rows.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("__s = 1").groupBy(*keys, "run").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count(F.lit(1)).alias("n"))


def viterbi(carry: np.ndarray, cm: np.ndarray) -> np.ndarray:
    """Most likely states (0 background, 1 archaic) of ordered sites; ties go to state 0."""
    n = len(carry)
    emit = np.log(np.array([[1 - E0, E0], [1 - E1, E1]]))[:, carry]
    stay = np.exp(-np.maximum(np.diff(cm), 0) / TAU_CM)
    to1 = (1 - stay) * PI1
    to0 = (1 - stay) * (1 - PI1)
    moves = np.log(np.maximum(np.array([[stay + to0, to1], [to0, stay + to1]]), 1e-12))  # from, to, site
    best = np.log([1 - PI1, PI1]) + emit[:, 0]
    back = np.zeros((n, 2), np.int8)
    for i in range(1, n):
        options = best[:, None] + moves[:, :, i - 1]
        back[i] = options[1] > options[0]
        best = options.max(0) + emit[:, i]
    path = np.zeros(n, np.int8)
    path[-1] = int(best[1] > best[0])
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def states(df: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """(keys, cm, carry, state) for groups of at least `least` sites; a group is one chromosome of one sample."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", cm double, carry int, state int"

    def path(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["cm", "carry"], kind="stable")
        if len(group) < least:
            return group.iloc[:0].assign(state=pd.Series(dtype="int32"))
        return group.assign(state=viterbi(group["carry"].to_numpy(), group["cm"].to_numpy()).astype("int32"))

    return df.select(*keys, "cm", F.col("carry").cast("int").alias("carry")).groupBy(*keys).applyInPandas(path, schema)


def summary(segments: DataFrame, key: str, span: Column) -> DataFrame:
    """Per key: number, longest, mean of the three longest, total, how many over 30 and 50, and the implied age 100 / mean."""
    w = Window.partitionBy(key).orderBy(F.col("__l").desc())
    rows = segments.withColumn("__l", span).withColumn("__r", F.row_number().over(w))
    top = F.avg(F.when(F.col("__r") <= 3, F.col("__l")))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("__l").alias("longest"), top.alias("top3"), F.sum("__l").alias("total"), F.count_if(F.col("__l") > 30).alias("over_30"), F.count_if(F.col("__l") > 50).alias("over_50"), (100 / F.nullif(F.avg("__l"), F.lit(0.0))).alias("age"))


def implied_ages(segments: DataFrame, keys: list[str], span: str) -> DataFrame:
    """Per key: generations to the ancestor, 100 / length in cM, from the longest segment and the mean of the three longest.

    Lengths are ranked once equal ones are counted, so a key's rows are combined before they meet.
    """
    per = segments.filter(F.col(span) > 0).groupBy(*keys, span).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy(F.col(span).desc()).rowsBetween(Window.unboundedPreceding, -1)
    taken = per.withColumn("__k", F.least("__c", F.greatest(F.lit(0), 3 - F.coalesce(F.sum("__c").over(before), F.lit(0)))))
    top3 = F.sum(F.col(span) * F.col("__k")) / F.sum("__k")
    return taken.filter("__k > 0").groupBy(*keys).agg((100 / F.max(span)).alias("age_longest"), (100 / top3).alias("age_top3"))


def source_shares(segments: DataFrame, sources: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, source, total, pct) of columns that count matches with each source; sources without any value go."""
    keys = keys or []
    sums = segments.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sources))
    whole = sum((F.coalesce(s, F.lit(0.0)) for s in sources), F.lit(0.0))
    long = sums.withColumn("__w", whole).unpivot([*keys, "__w"], list(sources), "source", "total")
    pct = 100 * F.col("total") / F.when(F.col("__w") == 0, 1.0).otherwise(F.col("__w"))
    return long.filter("total is not null").select(*keys, "source", "total", pct.alias("pct"))
