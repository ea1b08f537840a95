"""Allele frequencies per site and population from dosages (0, 1, 2 or NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allele_frequency(geno: DataFrame, *keys: str, dosage: str = "g") -> DataFrame:
    """(keys, p, n): mean dosage / 2 and the number of calls; p is NULL where there is none.

    One map-side combined aggregate; an individual of several populations comes in once for each.
    """
    return geno.groupBy(*keys).agg((F.avg(dosage) / 2).alias("p"), F.count(dosage).alias("n"))


def _exact_sums(value: str, unit: int) -> tuple[Column, Column, Column]:
    """Count, sum and sum of squares of value in whole 1 / unit."""
    x = F.round(F.col(value) * unit).cast("decimal(18,0)")
    return F.count(value), F.sum(x), F.sum((x * x).cast("decimal(27,0)"))


def exact_mean(value: str, unit: int = 1000000) -> Column:
    """Mean of values of at most six decimal places (unit), whatever the order of the rows; equal means are equal doubles."""
    c, s, _ = _exact_sums(value, unit)
    return s.cast("double") / F.nullif((c * unit).cast("double"), F.lit(0.0))


def exact_se(value: str, unit: int = 1000000) -> Column:
    """Standard error of exact_mean() from the sample deviation, 0 just where all values are equal; NULL under two values."""
    c, s, q = _exact_sums(value, unit)
    spread = (c * q).cast("decimal(38,0)") - (s.cast("decimal(19,0)") * s.cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.when(c > 1, F.sqrt(spread.cast("double") / F.nullif((c * c * (c - 1)).cast("double"), F.lit(0.0))) / unit)


def with_membership(geno: DataFrame, membership: DataFrame, on: str = "ind") -> DataFrame:
    """geno once for each distinct population that membership (ind, cohort) names for the individual."""
    return geno.join(membership.distinct(), on)


def cohort_frequency(geno: DataFrame, cohort: str, site: str = "site", ind: str = "ind", min_ind: int = 1, dosage: str = "g") -> DataFrame:
    """(site, cohort, p, n); cohorts of under min_ind individuals have NULL throughout."""
    members = geno.groupBy(cohort).agg(F.countDistinct(ind).alias("members"))
    freq = allele_frequency(geno, site, cohort, dosage=dosage).join(members, cohort)
    return freq.withColumn("p", F.when(F.col("members") >= min_ind, F.col("p")))


def wide(freq: DataFrame, site: str, pop: str, names: dict) -> DataFrame:
    """One row for each site with a column for each population of names {value: column}."""
    cols = [F.max(F.when(F.col(pop) == v, F.col("p"))).alias(c) for v, c in names.items()]
    return freq.groupBy(site).agg(*cols)


def derived(p: Column, chimp: Column) -> Column:
    """Frequency of the derived allele: p where the outgroup carries the other one, else 1 - p."""
    return F.when(chimp < 0.5, p).otherwise(1 - p)


def heterozygosity(geno: DataFrame, ind: str, pop: str, min_called: int) -> DataFrame:
    """(pop, n_ind, het, het_se): mean over individuals with more than min_called calls; SE from the population deviation."""
    per = geno.groupBy(ind, pop).agg(F.count_if(F.col("g") == 1).alias("hets"), F.count("g").alias("called"))
    per = per.filter(F.col("called") > min_called).withColumn("h", F.col("hets") / F.col("called"))
    return per.groupBy(pop).agg(F.count(F.lit(1)).alias("n_ind"), F.avg("h").alias("het"), (F.stddev_pop("h") / F.sqrt(F.count(F.lit(1)))).alias("het_se"))
