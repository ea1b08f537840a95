"""Shared helpers: shared-storage tables, chunked Arrow columns and vectorised word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text contracts: runs without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"

_U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as the session names it; a local session that names none, as in tests, gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="helixflow-")
        where = _own[app]
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    compact: the last stage runs as a few tasks for each core of the cluster, for tables of a few narrow columns that
    would otherwise be very many tiny files. The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    if compact:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/helixflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def drop_tables(paths: list[str] | None = None) -> None:
    """Delete the tables that materialize() wrote (all of them, or those in paths)."""
    for spark, path in list(_written):
        if paths is not None and path not in paths:
            continue
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone when the interpreter ends
            pass
        _written.remove((spark, path))


atexit.register(drop_tables)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_column(key: str, folds: int):
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


# ---------------------------------------------------------------- Arrow text columns


def text_chunks(column: pa.Array, limit: int = _CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about limit bytes; a row is never split, null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row, rows = 0, len(column)
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(rows, max(stop, row + 1))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class Words:
    """Lower-cased (A-Z) words of a chunk of rows, without a Python object per word."""

    _pow = np.empty(0, _U64)
    _inv = np.empty(0, _U64)

    def __init__(self, data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = _IN_WORD):
        """in_word: for each byte, whether words hold it."""
        self.data = _LOWER[data]
        inside = in_word[data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: words of row r are row_words[r] .. row_words[r + 1]
        self.row_words = np.searchsorted(self.starts, offsets)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._pow) < n:
            size = max(n, _CHUNK_BYTES + 4096)
            for name, base in (("_pow", _RADIX), ("_inv", pow(_RADIX, -1, 1 << 64))):
                steps = np.full(size, base, _U64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls._pow, cls._inv

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        if not len(self.starts):
            return np.empty(0, _U64)
        powers, inverse = self._powers(n)
        sums = np.zeros(n + 1, _U64)
        np.cumsum((self.data.astype(_U64) + _U64(1)) * powers[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix64(h + (self.ends - self.starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def strings(column: pa.Array) -> list[str]:
    """Rows as Python strings, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def with_arrays(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with the new columns; those of the same name are replaced."""
    names = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], names=[*names, *new])


def with_schema(df: DataFrame, new: str):
    """df's schema without the columns named in the DDL text new, then those columns."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    return StructType([f for f in df.schema.fields if f.name not in added.names] + added.fields)
