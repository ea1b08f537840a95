"""Packed genotype files as a Spark data source, the tables beside them, and writers.

A file has a header record and then records of 2-bit calls, the first in the high bits, 3 for missing: one record for
each site (GENO) or for each individual (TGENO). The reader plans partitions over ranges of records; a task seeks
to its records, reads the bytes that hold wanted calls and unpacks only these. Sizes are checked strictly against the
header.

Wanted sites and individuals are options, as runs of numbers. Filters are not pushed into the reader: in Spark 4.1.2 what
one query pushes into a Python source stays with its DataFrame, and the next query of it loses rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ordinals import numbered

HEADER = 48
AUTOSOMES = [str(i) for i in range(1, 23)]


def layout(path: str, n_ind: int, n_snp: int) -> tuple[bool, int, int]:
    """(by individual, offset of the first record, record length); ValueError where the file does not fit."""
    with open(path, "rb") as f:
        head = f.read(HEADER)
    size = os.path.getsize(path)
    fields = head.split()
    kind = fields[0] if fields else b""
    if kind == b"TGENO":
        transposed, offset, length, records = True, HEADER, -(-n_snp // 4), n_ind
    elif kind == b"GENO":
        length = max(HEADER, -(-n_ind // 4))
        transposed, offset, records = False, length, n_snp
    else:
        raise ValueError(f"{path}: neither GENO nor TGENO: {head[:5]!r}")
    if [int(x) for x in fields[1:3]] != [n_ind, n_snp]:
        raise ValueError(f"{path}: header counts {fields[1:3]} are not {n_ind} individuals and {n_snp} sites")
    if size != offset + records * length:
        raise ValueError(f"{path}: {size} bytes, {offset + records * length} expected")
    return transposed, offset, length


def runs(numbers) -> str:
    """Numbers as comma-joined runs, like 4-9,12; consecutive ones make one run."""
    x = np.asarray(list(numbers), np.int64)
    cuts = np.flatnonzero(np.diff(x) != 1) + 1
    return ",".join(f"{p[0]}-{p[-1]}" if len(p) > 1 else str(p[0]) for p in np.split(x, cuts) if len(p))


def _spans(text: str | None, n: int) -> np.ndarray:
    """The runs as rows (first, last)."""
    if text is None:
        return np.array([[0, n - 1]], np.int64)
    ends = [r.split("-") for r in text.split(",") if r]
    return np.array([(int(e[0]), int(e[-1])) for e in ends], np.int64).reshape(-1, 2)


def _expanded(spans: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.arange(a, b + 1) for a, b in spans)])


class _Range(InputPartition):
    def __init__(self, records: np.ndarray):
        self.records = records


#: Unwanted bytes between two wanted ones that are read rather than skipped.
_GAP = 1 << 12
#: Calls of a batch, and of a partition where the option `records` does not say otherwise.
_BATCH, _CALLS = 1 << 18, 1 << 24


class PackedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.n_ind, self.n_snp = int(options["n_ind"]), int(options["n_snp"])
        self.transposed, self.offset, self.length = layout(self.path, self.n_ind, self.n_snp)
        self.spans = {"ind_idx": _spans(options.get("inds"), self.n_ind), "geno_row": _spans(options.get("snps"), self.n_snp)}
        self.record, self.call = ("ind_idx", "geno_row") if self.transposed else ("geno_row", "ind_idx")
        self.per = int(options.get("records", 0))

    def partitions(self) -> list[InputPartition]:
        records, calls = _expanded(self.spans[self.record]), _expanded(self.spans[self.call])
        per = self.per or max(1, _CALLS // max(1, len(calls)))
        return [_Range(records[a : a + per]) for a in range(0, len(records) if len(calls) else 0, per)] or [_Range(records[:0])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        keep = _expanded(self.spans[self.call])
        byte, shift = keep >> 2, (6 - 2 * (keep & 3)).astype(np.uint8)
        wanted = np.unique(byte)
        pieces = np.split(wanted, np.flatnonzero(np.diff(wanted) > _GAP) + 1)
        pieces = [(int(w[0]), int(w[-1]) + 1) for w in pieces if len(w)]
        some = max(1, _BATCH // max(1, len(keep)))
        with open(self.path, "rb") as f:
            for a in range(0, len(partition.records), some):
                records = partition.records[a : a + some]
                g = np.empty((len(records), len(keep)), np.int8)
                raw = np.zeros(self.length, np.uint8)
                for row, record in zip(g, records.tolist()):
                    for start, stop in pieces:
                        f.seek(self.offset + record * self.length + start)
                        raw[start:stop] = np.frombuffer(f.read(stop - start), np.uint8)
                    row[:] = (raw[byte] >> shift) & 3
                numbers = {self.record: np.repeat(records, len(keep)), self.call: np.tile(keep, len(records))}
                g = g.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(numbers["geno_row"]), pa.array(numbers["ind_idx"]), pa.array(g, mask=g == 3)], names=["geno_row", "ind_idx", "g"])


class PackedGenotypes(DataSource):
    """Options: path, n_ind, n_snp; inds and snps (comma-joined numbers and runs, any order), records a partition."""

    @classmethod
    def name(cls) -> str:
        return "packedgeno"

    def schema(self) -> str:
        return "geno_row bigint, ind_idx bigint, g tinyint"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options)


def genotypes(spark: SparkSession, path: str, n_ind: int, n_snp: int, inds=None, snps=None, records: int | None = None) -> DataFrame:
    """(geno_row, ind_idx, g) with NULL for missing; only the named individuals and sites are unpacked.

    inds and snps are numbers or a text of runs(), each number once.
    """
    spark.dataSource.register(PackedGenotypes)
    r = spark.read.format("packedgeno").option("n_ind", n_ind).option("n_snp", n_snp)
    for key, value in (("inds", inds), ("snps", snps)):
        if value is not None:
            r = r.option(key, value if isinstance(value, str) else runs(value))
    return (r.option("records", records) if records else r).load(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, t): numbered lines as arrays of tokens. Individual and site lists are small beside the genotypes."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), F.monotonically_increasing_id().alias("at"))


def _ordinal(df: DataFrame, to: str) -> DataFrame:
    """Consecutive numbers in file order."""
    return numbered(df, ["at"], to).drop("at")


def individuals(spark: SparkSession, path: str) -> DataFrame:
    """(ind_idx, id, sex, pop); lines of under three tokens are skipped."""
    t = F.col("t")
    return _ordinal(_lines(spark, path).filter(F.size(t) >= 3), "ind_idx").select("ind_idx", t[0].alias("id"), t[1].alias("sex"), t[2].alias("pop"))


def snps(spark: SparkSession, path: str) -> DataFrame:
    """(geno_row, name, chrom, gpos, pos, a1, a2) in the file's order; gpos in Morgans."""
    t = F.col("t")
    rows = _ordinal(_lines(spark, path).filter(F.size(t) >= 6), "geno_row")
    return rows.select("geno_row", t[0].alias("name"), t[1].alias("chrom"), t[2].cast("double").alias("gpos"), t[3].cast("bigint").alias("pos"), t[4].alias("a1"), t[5].alias("a2"))


class Panel:
    """A panel's three tables; only autosomes unless said otherwise."""

    def __init__(self, spark: SparkSession, prefix: str, autosomes: bool = True):
        self.spark, self.prefix = spark, prefix
        self.ind, every = individuals(spark, prefix + ".ind").cache(), snps(spark, prefix + ".snp").cache()
        self.n_ind, self.n_snp = self.ind.count(), every.count()
        self.snp = every.filter(F.col("chrom").isin(AUTOSOMES)) if autosomes else every

    def members(self, spec: dict[str, dict]) -> DataFrame:
        """(cohort, ind_idx) of {name: {ids: [...], pops: [...]}}; unknown names are ignored, of equal ids the last counts."""
        last = self.ind.groupBy("id").agg(F.max("ind_idx").alias("ind_idx"))
        parts = []
        for name, s in spec.items():
            label = F.lit(name).alias("cohort")
            parts.append(last.filter(F.col("id").isin(list(s.get("ids", [])))).select(label, "ind_idx"))
            parts.append(self.ind.filter(F.col("pop").isin(list(s.get("pops", [])))).select(label, "ind_idx"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    def calls(self, members: DataFrame) -> DataFrame:
        """(geno_row, cohort, ind_idx, g) of the cohorts' individuals at the panel's sites."""
        wanted = sorted(r[0] for r in members.select("ind_idx").distinct().collect())  # a list of individuals
        g = genotypes(self.spark, self.prefix + ".geno", self.n_ind, self.n_snp, inds=wanted, snps=self.site_runs())
        return g.join(members, "ind_idx")

    def site_runs(self) -> str:
        """The panel's sites as runs; a file in the order of chromosomes has at most one for each."""
        place = F.row_number().over(Window.partitionBy("chrom").orderBy("geno_row"))
        each = self.snp.select("geno_row", "chrom", (F.col("geno_row") - place).alias("run")).groupBy("chrom", "run")
        found = each.agg(F.min("geno_row").alias("a"), F.max("geno_row").alias("b")).orderBy("a").collect()
        return ",".join(f"{r['a']}-{r['b']}" for r in found)

    def frequencies(self, spec: dict[str, dict]) -> DataFrame:
        """(geno_row, cohort, p, n)."""
        from ..operators.frequency import allele_frequency

        return allele_frequency(self.calls(self.members(spec)), "geno_row", "cohort")


# ---------------------------------------------------------------- writers


def pack(codes: np.ndarray, length: int) -> np.ndarray:
    """Bytes of rows of codes 0-3, padded with zero bytes to length."""
    rows, n = codes.shape
    padded = np.zeros((rows, length * 4), np.uint8)
    padded[:, :n] = codes
    q = padded.reshape(rows, length, 4)
    return (q[..., 0] << 6) | (q[..., 1] << 4) | (q[..., 2] << 2) | q[..., 3]


def write_packed(path: str, dosage: np.ndarray, transposed: bool = True) -> None:
    """Writes dosages (individuals by sites, -1 missing)."""
    n_ind, n_snp = dosage.shape
    codes = np.where(dosage < 0, 3, dosage).astype(np.uint8)
    kind = "TGENO" if transposed else "GENO"
    length = -(-n_snp // 4) if transposed else max(HEADER, -(-n_ind // 4))
    head = f"{kind} {n_ind} {n_snp} 0 0".encode().ljust(HEADER if transposed else length, b"\0")
    with open(path, "wb") as f:
        f.write(head)
        f.write(pack(codes if transposed else codes.T, length).tobytes())


def write_ind(path: str, rows) -> None:
    with open(path, "w") as f:
        f.writelines(f"{i}\t{sex}\t{pop}\n" for i, sex, pop in rows)


def write_snp(path: str, rows) -> None:
    with open(path, "w") as f:
        f.writelines("\t".join(map(str, r)) + "\n" for r in rows)


def bed_rows(calls: DataFrame, n_ind: int) -> DataFrame:
    """(geno_row, bytes): PLINK rows of (geno_row, ind_idx, g); 2 -> 0, 1 -> 2, 0 -> 3, missing -> 1, low bits first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                codes = np.ones(-(-n_ind // 4) * 4, np.uint8)
                codes[n_ind:] = 0
                for x in row:
                    if x["g"] is not None:
                        codes[x["ind_idx"]] = (3, 2, 0)[x["g"]]
                q = codes.reshape(-1, 4)
                out.append((q[:, 0] | (q[:, 1] << 2) | (q[:, 2] << 4) | (q[:, 3] << 6)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["geno_row", "bytes"])

    rows = calls.groupBy("geno_row").agg(F.collect_list(F.struct("ind_idx", "g")).alias("calls"))
    return rows.mapInArrow(run, "geno_row bigint, bytes binary")


def write_plink(prefix: str, calls: DataFrame, snp: DataFrame, ind: DataFrame, n_ind: int) -> None:
    """.bed, .bim and .fam on the driver's disk, sites in the panel's order, streamed row by row."""
    with open(prefix + ".bed", "wb") as f:
        f.write(b"\x6c\x1b\x01")
        for r in bed_rows(calls, n_ind).orderBy("geno_row").toLocalIterator():
            f.write(bytes(r["bytes"]))
    with open(prefix + ".bim", "w") as f:
        for r in snp.orderBy("geno_row").toLocalIterator():
            f.write(f"{r['chrom']}\t{r['name']}\t{r['gpos']}\t{r['pos']}\t{r['a1']}\t{r['a2']}\n")
    with open(prefix + ".fam", "w") as f:
        for r in ind.orderBy("ind_idx").toLocalIterator():
            f.write(f"{r['pop']}\t{r['id']}\t0\t0\t{ {'M': 1, 'F': 2}.get(r['sex'], 0)}\t-9\n")


def character_rows(calls: DataFrame, members: int, min_call_rate: float = 0.5) -> DataFrame:
    """(geno_row, value): one character for each individual in order, 9 for missing; sites under the call rate are left out."""
    per = calls.groupBy("geno_row").agg(F.sort_array(F.collect_list(F.struct("ind_idx", F.coalesce(F.col("g").cast("string"), F.lit("9")).alias("c")))).alias("x"), (F.count("g") / members).alias("rate"))
    return per.filter(F.col("rate") >= min_call_rate).select("geno_row", F.concat_ws("", F.transform("x", lambda c: c["c"])).alias("value"))


def read_character_rows(spark: SparkSession, path: str) -> DataFrame:
    """(geno_row, ind_idx, g) of a character matrix, one line a site."""
    rows = _ordinal(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")), "geno_row")
    chars = rows.select("geno_row", F.posexplode(F.split("value", "")).alias("ind_idx", "c")).filter("c <> ''")
    return chars.select("geno_row", F.col("ind_idx").cast("bigint").alias("ind_idx"), F.when(F.col("c") != "9", F.col("c")).cast("tinyint").alias("g"))
