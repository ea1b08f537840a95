"""Approximate nearest neighbours by inner product: p-stable hashing with multiprobe, then exact distances.

Inner products become distances by one more coordinate: sqrt(M^2 - |x|^2) for rows, 0 for queries, which are scaled to
length M, the largest row's. The order of distances is then that of inner products.

A table hashes a vector by floor((a.x + b) / W) for each of several Gaussian directions a (2-stable, so a difference of
length d becomes a normal one of deviation d). A query visits buckets in the order of their estimated success, the normal
probability that a neighbour at the usual distance lies there, up to a total that is the same for all queries. Tables
are merged, and candidates ranked by their exact inner products.

Parameters are set by the data: W by the distances of the true neighbours of CALIBRATION queries (brute force against all
rows), the number of functions by a sample of SAMPLE rows, so that half the rows lie in buckets of at most BUCKET_ROWS,
and the total of success so that RECALL of those true neighbours is met; if PROBES buckets a table can't reach that,
functions are given up one by one (with none, every row is visited). These three samples are the only bounded ones: every
row is indexed and every query answered. Queries that meet fewer than k rows are searched again against all rows.

Of rows of one vector, those of the k + 1 smallest ids are indexed; no other can be among anyone's k nearest. A bucket is
dealt to tasks in chunks of at most ROWS rows and about QUERIES queries, so neither hot buckets nor near copies by the
million meet in one task.

Buckets are visited in rounds (_ROUNDS, by place in the order of success). A query's kth best score so far is its bar in
the next round: only rows that reach it leave a chunk. So what a query gathers grows with k, not with its visits.

Defined results: vectors that are null, empty, zero, of another length than most (the shorter of equally usual ones) or
hold null or non-finite components take no part, nor do rows with a null id. A query does not find rows of its own id.
Repeated ids are separate rows, as candidates and as queries. Equal scores are ordered by id. Empty tables give no rows.
Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
TABLES = 2
#: Share of true neighbours that the calibration has to meet.
RECALL = 0.97
CALIBRATION = 128
SAMPLE = 8192
BUCKET_ROWS = 512
#: Most functions of a table, buckets a query visits in it, and steps away from its own bucket a function.
FUNCTIONS = 24
PROBES = 512
REACH = 3
#: Rows and queries of a chunk.
ROWS = 4096
QUERIES = 1024
SEED = 20

#: A query's first bucket of each table, the next ones, the rest.
_ROUNDS = (1, 12)

_U64 = np.uint64
_VECTOR = "id bigint, vec binary, dim int, norm double"
_FOUND = "query_id bigint, query bigint, vec_id bigint, row bigint, score double"


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, dim, norm) of the rows that take part, lengths aside; vec holds their components as bytes."""
    kind = _kind(df, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                ids, lists = batch.column(0)[a : a + 1024], batch.column(1)[a : a + 1024]
                size = np.asarray(lists.value_lengths().fill_null(0))
                out: list = []
                for dim in np.unique(size[size > 0]):
                    at = np.flatnonzero(size == dim)
                    x = np.asarray(lists.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(at), dim)
                    good = np.isfinite(x).all(1) & (x != 0).any(1)
                    with np.errstate(over="ignore"):
                        norm = np.sqrt((x[good] ** 2).sum(1))
                    out += zip(ids.take(pa.array(at[good])).to_pylist(), (v.tobytes() for v in x[good].astype(kind)), [int(dim)] * int(good.sum()), norm.tolist())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int32(), pa.float64()))], names=["id", "vec", "dim", "norm"])

    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(vector_col)).mapInArrow(run, _VECTOR)


def _kind(df: DataFrame, vector_col: str) -> str:
    """The numpy type that holds the components exactly."""
    return "f4" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "f8"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a binary column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty((0, dim))
    kind = np.dtype(f"f{(offsets[1] - offsets[0]) // dim}")
    return np.frombuffer(data, kind, count=len(column) * dim, offset=int(offsets[0])).reshape(len(column), dim).astype(np.float64)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 4 digits."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.07056 * x**3, -60, 60)))


class Hashes:
    """The functions of all tables; those in use are the first `functions` of each."""

    def __init__(self, dim: int, longest: float, distance: float, functions: int, tables: int = TABLES):
        rng = np.random.default_rng(SEED)
        self.longest, self.distance, self.functions, self.tables = longest, distance, functions, tables
        self.width = 1.5 * distance
        self.a = rng.standard_normal((tables, FUNCTIONS, dim + 1))
        self.b = rng.random((tables, FUNCTIONS))
        self.odd = rng.integers(1 << 62, size=(tables, FUNCTIONS), dtype=np.int64).astype(_U64) * _U64(2) + _U64(1)
        self.total = 0.0  # of success that queries visit

    def _spots(self, t: int, steps: np.ndarray, f: int) -> np.ndarray:
        return steps.astype(np.int64).view(_U64) * self.odd[t, f]

    def values(self, t: int, x: np.ndarray, query: bool) -> np.ndarray:
        """What the functions of a table give before rounding."""
        norm = np.sqrt((x**2).sum(1))
        if query:
            last, x = np.zeros(len(x)), x * (self.longest / norm)[:, None]
        else:
            last = np.sqrt(np.maximum(self.longest**2 - norm**2, 0))
        a = self.a[t, : self.functions]
        return (x @ a[:, :-1].T + last[:, None] * a[:, -1]) / self.width + self.b[t, : self.functions]

    def spots(self, t: int, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in a table, as a number that also names the table."""
        steps = np.floor(self.values(t, x, False))
        out = np.full(len(x), t, _U64)
        for f in range(self.functions):
            out += self._spots(t, steps[:, f], f)
        return out.view(np.int64)

    def probes(self, t: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets in the order of their success and the success of all before each; both (queries, probes)."""
        value = self.values(t, q, True)
        home = np.floor(value)
        spread = self.distance / self.width
        logs, spots = np.zeros((len(q), 1)), np.full((len(q), 1), t, _U64)
        for f in range(self.functions):  # the best of all functions are among the best of the first ones
            steps = home[:, f : f + 1] + np.arange(-REACH, REACH + 1)
            low = (steps - value[:, f : f + 1]) / spread
            success = np.maximum(_normal(low + 1 / spread) - _normal(low), 1e-30)
            logs = (logs[:, :, None] + np.log(success)[:, None, :]).reshape(len(q), -1)
            spots = (spots[:, :, None] + self._spots(t, steps, f)[:, None, :]).reshape(len(q), -1)
            if logs.shape[1] > PROBES:
                best = np.argpartition(-logs, PROBES - 1, axis=1)[:, :PROBES]
                logs, spots = np.take_along_axis(logs, best, 1), np.take_along_axis(spots, best, 1)
        by = np.argsort(-logs, axis=1, kind="stable")
        share = np.exp(np.take_along_axis(logs, by, 1))
        return np.take_along_axis(spots, by, 1).view(np.int64), np.cumsum(share, axis=1) - share


def _best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows of a score of `least` or more; scores are sums in the order of the components."""
    rough = q @ x.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    bar = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    bar = np.maximum(bar, least)
    # within the error of a sum, so that ties are seen exactly
    slip = 1e-12 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1).max(initial=0)) + 1e-300
    who, row = np.nonzero((rough >= np.where(np.isfinite(bar), bar - slip, -np.inf)[:, None]) & (rough > -np.inf))
    score = np.zeros(len(who))
    for j in range(x.shape[1]):
        score += q[who, j] * x[row, j]
    good = score >= (least[who] if isinstance(least, np.ndarray) else least)
    who, row, score = who[good], row[good], score[good]
    by = np.lexsort((ids[row], -score, who))
    who, row, score = who[by], row[by], score[by]
    starts = np.searchsorted(who, np.arange(len(q)))
    keep = np.arange(len(who)) - starts[who] < k
    return who[keep], row[keep], score[keep]


def _true_neighbours(rows: DataFrame, held, dim: int, k: int) -> DataFrame:
    """The k nearest rows of a broadcast (ids, vectors) of few queries, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = held.value
        for batch in batches:
            if batch.num_rows:
                x, ids = _matrix(batch.column(1), dim), np.asarray(batch.column(0))
                who, row, score = _best(x, ids, q, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[row]), pa.array(score), batch.column(1).take(pa.array(row))], names=["query", "vec_id", "score", "vec"])

    near = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    found = rows.select("id", "vec").mapInArrow(run, "query bigint, vec_id bigint, score double, vec binary")
    return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)


def _sample(df: DataFrame, n: int) -> tuple[np.ndarray, list[bytes]]:
    """n rows by the hash of id and vector: at most that many reach the driver."""
    got = df.select("id", "vec").orderBy(F.xxhash64("id", "vec"), "id").limit(n).collect()
    return np.array([r[0] for r in got], np.int64), [bytes(r[1]) for r in got]


def fit(rows: DataFrame, queries: DataFrame, dim: int, longest: float, n: int, k: int, recall: float) -> Hashes:
    """Hashes whose visits meet `recall` of the true neighbours of the calibration's queries."""
    stack = lambda vs: _matrix(pa.array(vs, pa.binary()), dim)
    own, vecs = _sample(queries, CALIBRATION)
    if not len(own):
        return Hashes(dim, longest, longest, 0)
    q = stack(vecs)
    near = _true_neighbours(rows, rows.sparkSession.sparkContext.broadcast((own, q)), dim, k).collect()
    if not near:
        return Hashes(dim, longest, longest, 0)
    who, x, score = np.array([r["query"] for r in near]), stack([bytes(r["vec"]) for r in near]), np.array([r["score"] for r in near])
    apart = np.sqrt(np.maximum(2 * longest**2 - 2 * score * longest / np.sqrt((q[who] ** 2).sum(1)), 0))
    hashes = Hashes(dim, longest, max(float(np.quantile(apart, 0.75)), 1e-3 * longest), FUNCTIONS)
    some = stack(_sample(rows, SAMPLE)[1])
    for hashes.functions in range(FUNCTIONS + 1):
        like = []
        for t in range(hashes.tables):
            _, at, count = np.unique(hashes.spots(t, some), return_inverse=True, return_counts=True)
            like.append(np.median(count[at] - 1) / max(1, len(some) - 1) * n)
        if np.mean(like) <= BUCKET_ROWS:
            break
    while hashes.functions:
        before = np.full(len(who), np.inf)
        for t in range(hashes.tables):
            spots, success = hashes.probes(t, q)
            met = spots[who] == hashes.spots(t, x)[:, None]
            place = met.argmax(1)
            before = np.minimum(before, np.where(met.any(1), success[who, place], np.inf))
        need = float(np.sort(before)[min(len(before) - 1, int(np.ceil(recall * len(before))))])
        if np.isfinite(need):
            hashes.total = float(np.nextafter(need, np.inf))
            break
        hashes.functions -= 1
    return hashes


def _visited(queries: DataFrame, held, dim: int) -> DataFrame:
    """(id, query, spot, round): the buckets that each query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                q = _matrix(part.column(2), dim)
                for t in range(hashes.tables if hashes.functions else 1):
                    spots, before = hashes.probes(t, q)
                    who, place = np.nonzero(before < max(hashes.total, 1e-300))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array(spots[who, place]), pa.array(np.searchsorted(_ROUNDS, place, side="right").astype(np.int32))], names=["id", "query", "spot", "round"])

    return queries.select("id", "query", "vec").mapInArrow(run, "id bigint, query bigint, spot bigint, round int")


def _indexed(rows: DataFrame, held, dim: int, k: int) -> DataFrame:
    """(id, vec, spots): all rows that can be among anyone's k nearest, with their bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(part.column(1), dim)
                spots = np.stack([hashes.spots(t, x) for t in range(hashes.tables if hashes.functions else 1)], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(spots.ravel()), spots.shape[1]).cast(pa.list_(pa.int64()))], names=["id", "vec", "spots"])

    copies = Window.partitionBy("vec").orderBy("id")
    one = rows.select("id", "vec", F.row_number().over(copies).alias("copy")).filter(F.col("copy") <= k + 1)
    return one.select("id", "vec").mapInArrow(run, "id bigint, vec binary, spots array<bigint>")


def _searched(index: DataFrame, queries: DataFrame, visits: DataFrame, dim: int, k: int) -> DataFrame:
    """Rows of the buckets that each query visits, its k best of each chunk among those that reach its bar.

    index: (row, id, vec, spot); queries: (id, query, vec, bar); visits: (id, query, spot).
    """
    asked = visits.groupBy("spot").agg(F.count(F.lit(1)).alias("asked"))
    sizes = index.groupBy("spot").agg(F.count(F.lit(1)).alias("size")).join(asked, "spot")
    sizes = materialize(sizes.select("spot", F.ceil(F.col("size") / ROWS).cast("int").alias("rows"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("queries")), "spots", compact=True)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    left = index.join(sizes, "spot").withColumn("r", dealt("rows", "id", "vec")).withColumn("q", each("queries")).select("spot", "r", "q", "row", "id", "vec")
    right = visits.join(sizes, "spot").select("id", "query", "spot", dealt("queries", "id", "query").alias("q"), "rows")
    right = right.join(queries, ["id", "query"]).withColumn("r", each("rows")).select("spot", "r", "q", "id", "query", "vec", "bar")

    def run(found: pa.Table, asked: pa.Table) -> pa.Table:
        names = ("query_id", "query", "vec_id", "row", "score")
        if not found.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names], names=names)
        x, q = _matrix(found["vec"], dim), _matrix(asked["vec"], dim)
        ids, own, bar = found["id"].to_numpy(), asked["id"].to_numpy(), asked["bar"].to_numpy()
        parts = []
        for a in range(0, len(q), 256):
            who, row, score = _best(x, ids, q[a : a + 256], own[a : a + 256], k, bar[a : a + 256])
            parts.append((who + a, row, score))
        who, row, score = (np.concatenate(p) for p in zip(*parts))
        return pa.table([pa.array(own[who]), pa.array(asked["query"].to_numpy()[who]), pa.array(ids[row]), pa.array(found["row"].to_numpy()[row]), pa.array(score)], names=names)

    key = ("spot", "r", "q")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """found's k best rows of each query with their rank; a row met in several tables or rounds has one place."""
    near = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.dense_rank().over(near)).filter(F.col("rank") <= k).dropDuplicates(["query_id", "query", "rank"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query, nearest first."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    x, q = vectors(rows, id_col, vector_col), vectors(queries, id_col, vector_col)
    lengths = x.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return none
    dim, n, longest = lengths
    x, q = x.filter(F.col("dim") == dim), q.filter(F.col("dim") == dim)
    # queries of one id and vector are one query
    q = q.select("id", "vec", F.xxhash64("vec").alias("query")).dropDuplicates(["id", "query"])
    hashes = fit(x, q, dim, longest, n, k, recall)
    held = spark.sparkContext.broadcast(hashes)
    index = materialize(_indexed(x, held, dim, k).withColumn("row", F.monotonically_increasing_id()), "index")
    visits = materialize(_visited(q, held, dim), "visits")
    placed = index.select("row", "id", "vec", F.explode("spots").alias("spot"))
    low = F.lit(float("-inf"))
    out = None
    for r in range(len(_ROUNDS) + 1 if hashes.functions else 1):
        asking = q.withColumn("bar", low)
        if out is not None:
            bars = out.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "query", F.col("score").alias("bar"))
            asking = q.join(bars, ["id", "query"], "left").withColumn("bar", F.coalesce("bar", low))
        found = _searched(placed, asking, visits.filter(F.col("round") == r), dim, k)
        out = materialize(_ranked(found if out is None else out.drop("rank").unionByName(found), k), "nearest")
    if hashes.functions:
        short = q.join(out.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "query"), ["id", "query"], "left_anti")
        if not short.isEmpty():
            everywhere = F.lit(0).cast("bigint").alias("spot")
            again = _searched(index.select("row", "id", "vec", everywhere), short.withColumn("bar", low), short.select("id", "query", everywhere), dim, k)
            out = out.join(short.select(F.col("id").alias("query_id"), "query"), ["query_id", "query"], "left_anti").unionByName(_ranked(again, k))
    return out.select("query_id", "rank", "vec_id", "score")
