"""A store of cohorts' frequencies, of which only cohorts that changed are computed again.

Two parquet tables partitioned by cohort: `profiles` (geno_row, p, n, digest) and `info` (digest, members, sites). A
cohort's digest covers its members and the version of the panel. Profiles are written before info, and rows are served
only where both have the same digest: a run that dies between leaves the cohort out of date, not mixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

_PROFILES = "geno_row bigint, p double, n bigint, digest string, cohort string"
_INFO = "digest string, members bigint, sites bigint, cohort string"


def digests(members: DataFrame, version: str = "") -> DataFrame:
    """(cohort, digest, members) of (cohort, ind_idx): order does not matter, repeated rows count once."""
    h = F.xxhash64("ind_idx", F.lit(version))
    per = members.select("cohort", "ind_idx").distinct().groupBy("cohort")
    sums = per.agg(F.count(F.lit(1)).alias("members"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return sums.select("cohort", F.concat_ws(":", "members", "x", "s", F.lit(version)).alias("digest"), "members")


class ProfileStore:
    """Cohort names are text and not NULL; rows without a cohort are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:  # nothing stored yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cohort").parquet(f"{self.path}/{name}")

    def info(self) -> DataFrame:
        """(cohort, digest, members, sites): sites with a frequency."""
        return self._read("info", _INFO)

    def load(self, cohorts: list[str] | None = None) -> DataFrame:
        """(cohort, geno_row, p, n); with cohorts, only their partitions are read."""
        rows, info = self._read("profiles", _PROFILES), self.info()
        if cohorts is not None:
            rows, info = (x.filter(F.col("cohort").isin(cohorts)) for x in (rows, info))
        return rows.join(info.select("cohort", "digest"), ["cohort", "digest"], "left_semi").select("cohort", "geno_row", "p", "n")

    def update(self, members: DataFrame, frequencies: Callable[[DataFrame], DataFrame], version: str = "") -> list[str]:
        """Brings the cohorts of members (cohort, ind_idx) up to date and names those that were computed.

        frequencies gives (geno_row, cohort, p, n) of the members that it gets. Stored cohorts that members does not name stay.
        """
        members = members.filter("cohort is not null")
        stale = checkpointed(digests(members, version).join(self.info(), ["cohort", "digest"], "left_anti"))  # info is overwritten below
        names = [r["cohort"] for r in stale.orderBy("cohort").select("cohort").collect()]
        if names:
            fresh = frequencies(members.join(stale.select("cohort"), "cohort", "left_semi"))
            self._write(fresh.join(stale.select("cohort", "digest"), "cohort").select("geno_row", "p", F.col("n").cast("bigint").alias("n"), "digest", "cohort"), "profiles")
            sites = self._read("profiles", _PROFILES).join(stale.select("cohort", "digest"), ["cohort", "digest"], "left_semi").groupBy("cohort").agg(F.count("p").alias("sites"))
            self._write(stale.join(sites, "cohort", "left").select("digest", "members", F.coalesce("sites", F.lit(0).cast("bigint")).alias("sites"), "cohort"), "info")
        return names
