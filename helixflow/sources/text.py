"""Metadata tables with long headers, consumer genotype files, segment tables, resumable parquet output."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.qc import numeric

class Header(NamedTuple):
    """What a lower-cased header must be like: begin with one of starts, or hold one phrase of each group of holds."""

    starts: tuple[str, ...] = ()
    holds: tuple[tuple[str, ...], ...] = ()
    without: str | None = None
    exact: bool = False
    number: bool = False

    def fits(self, header: str) -> bool:
        if self.exact:
            return header in self.starts
        if self.without and self.without in header:
            return False
        return header.startswith(self.starts) if self.starts else all(any(w in header for w in group) for group in self.holds)


# Phrases in the headers of published sample tables.
FIELDS = {
    "genetic_id": Header(("genetic id",)),
    "master_id": Header(("master id", "version id")),
    "group_id": Header(("group id",)),
    "locality": Header(("locality",)),
    "country": Header(("political entity",)),
    "lat": Header(("lat",), number=True),
    "lon": Header(("long",), number=True),
    "date_bp": Header(("date mean in bp",), number=True),
    "date_sd": Header(("date standard deviation",), number=True),
    "full_date": Header(("full date",)),
    "coverage": Header(("mean coverage on",), number=True),
    "snps_2m": Header(holds=(("snps hit",), ("2m capture", "enhance 2m")), number=True),
    "snps_1240k": Header(holds=(("snps hit",), ("1240k snpset",)), number=True),
    "snps_ho": Header(holds=(("snps hit",), ("ho snpset",)), without="compatibility", number=True),
    "mol_sex": Header(("molecular sex",)),
    "assessment": Header(("assessment",), exact=True),
    "assess_warn": Header(("assessment warnings",)),
    "angsd": Header(("angsd mom",)),
    "hapconx": Header(("hapconx",)),
    "damage": Header(("damage rate in first",), number=True),
    "y_hap": Header(("y haplogroup in terminal",)),
    "mt_hap": Header(("mtdna haplogroup",)),
}


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Canonical columns of a tab-separated sample table; each is the first header that fits, NULL without one."""
    rows = spark.read.csv(path, sep="\t", quote='"', header=True, inferSchema=False)
    heads = [(c, c.strip().lower()) for c in rows.columns]
    cols = []
    for name, header in FIELDS.items():
        found = next((c for c, h in heads if header.fits(h)), None)
        value = F.lit(None).cast("string") if found is None else F.trim(F.col(f"`{found}`"))
        cols.append((numeric(value) if header.number else F.nullif(value, F.lit(""))).alias(name))
    return rows.select(*cols)


def consumer_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, chrom, pos, geno): two upper-case characters; single ones are doubled, other lengths, headers and sex chromosomes go."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace(F.trim("value"), "[\"']", "").alias("v"))
    rows = rows.filter(~F.col("v").startswith("#") & (F.col("v") != ""))
    t = F.when(F.col("v").contains(","), F.split("v", ",")).otherwise(F.split("v", r"\s+"))
    rows = rows.select("line_no", t.alias("t")).filter(F.size("t") >= 4)
    geno = F.upper(F.trim(F.col("t")[3]))
    rows = rows.select("line_no", F.trim(F.col("t")[1]).alias("chrom"), F.trim(F.col("t")[2]).try_cast("bigint").alias("pos"), F.when(F.length(geno) == 1, F.concat(geno, geno)).otherwise(geno).alias("geno"))
    return rows.filter(F.col("chrom").isin([str(i) for i in range(1, 23)]) & F.col("pos").isNotNull() & (F.length("geno") == 2))


# Names of columns of decode tables, first found first; archaics; cM a megabase where there is no genetic map.
SEGMENT_COLUMNS = {
    "chrom": ("chrom", "chr", "chromosome"),
    "start": ("start", "begin"),
    "end": ("end", "stop"),
    "state": ("state",),
    "prob": ("mean_prob", "prob"),
    "genetic": ("genetic_length", "length_cm", "cm"),
    "length": ("length",),
}
ARCHAICS = ("altai", "vindija", "chagyrskaya", "denisova")
CM_PER_MB = 1.3


def archaic_segments(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, state, prob, cm, and a column for each archaic) of a whitespace decode table with a header.

    Rows are those whose state names an archaic (all, without such a column). cm is the genetic length, or else the
    length or end - start at CM_PER_MB. Columns that the table lacks and numbers that are none are NULL.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"))
    head = lines.first()["t"]
    names = [h.lower() for h in head]
    known = SEGMENT_COLUMNS | {a: (a, f"{a}_snps", f"shared_with_{a}") for a in ARCHAICS}
    at = {k: next((names.index(n) for n in options if n in names), None) for k, options in known.items()}
    token = lambda k: F.lit(None).cast("string") if at[k] is None else F.get("t", F.lit(at[k]))
    number = lambda k, kind="double": token(k).try_cast(kind).alias(k)
    rows = lines.filter(F.col("t") != F.array(*map(F.lit, head)))
    rows = rows.select(token("chrom").alias("chrom"), number("start", "bigint"), number("end", "bigint"), token("state").alias("state"), number("prob"), number("genetic"), number("length"), *map(number, ARCHAICS))
    base = "length" if at["length"] is not None else F.col("end") - F.col("start")
    cm = F.col("genetic") if at["genetic"] is not None else (F.col(base) if isinstance(base, str) else base) / 1e6 * CM_PER_MB
    rows = rows.select("chrom", "start", "end", "state", "prob", F.when(~F.isnan(cm), cm).alias("cm"), *ARCHAICS)
    return rows if at["state"] is None else rows.filter(F.lower("state").contains("archaic"))


def write_table(df: DataFrame, path: str, csv: str | None = None, single: bool = False) -> None:
    """df as parquet at path and, for readers of text, as CSV with a header at csv.

    The CSV has a part for each partition; single makes one part, for results that one task can write. It is made of
    the parquet that was written, so df is computed once.
    """
    df.write.mode("overwrite").parquet(path)
    if csv:
        rows = df.sparkSession.read.schema(df.schema).parquet(path)
        (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(csv, header=True, escape='"')


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema, by name, of CSV with a header: types are declared, no pass over the data infers them.

    CSV does not tell an empty text from NULL: both are NULL, as is what is not of its type.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)
    types = StructType.fromDDL(schema)
    return rows.select(*(F.col(f"`{f.name}`").try_cast(f.dataType.simpleString()).alias(f.name) for f in types))


def append_new(new: Callable[[DataFrame], DataFrame], samples: DataFrame, path: str, key: str) -> int:
    """Computes and appends results for the samples that the parquet table at path has none of yet; returns how many."""
    spark = samples.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    todo = samples if done is None else samples.join(done, key, "left_anti")
    n = todo.count()
    if n:
        new(todo).write.mode("append").parquet(path)
    return n
