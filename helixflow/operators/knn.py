"""Exact nearest neighbours and the neighbourhood expectation built on them.

References are dealt to cells, each around the nearest of some pivots, and cells beyond BLOCK rows are cut into pieces. A
query first visits the pieces around it until they hold k references; their kth distance then rules out, by the triangle
inequality, the pieces that cannot hold a nearer one, and it visits the rest. A task holds one piece and streams the
queries that visit it past it. The driver sees the pivots and one row a cell; no pair of rows is ever a row of a plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .aggregates import weighted_mean, zscore

#: References in a piece, which one task holds.
BLOCK = 1 << 16
#: References that a pivot stands for, and the most pivots.
CELL, PIVOTS = 1 << 12, 1 << 10
#: Queries that one copy of a piece serves; a piece that more of them visit is held by several tasks.
VISITS = 1 << 16
_ROWS = 512
#: Candidates that are compared exactly at once; a query has up to a block of them where references tie.
_PAIRS = 1 << 18


def _first(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, maybe: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in x, squared distance) of the m nearest candidates of each row, ties by id; maybe: rows by candidates."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    ends = np.cumsum(maybe.sum(1))
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, side="right")))
        at, near = np.nonzero(maybe[start:stop])
        exact = np.concatenate([np.empty(0), *(((rows[start + at[a : a + _PAIRS // 16]] - x[near[a : a + _PAIRS // 16]]) ** 2).sum(1) for a in range(0, len(at), _PAIRS // 16))])
        order = np.lexsort((ids[near], exact, at))
        at, near, exact = at[order], near[order], exact[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < m
        out.append((start + at[keep], near[keep], exact[keep]))
        start = stop
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rough(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and the most that rounding may have changed them for each row."""
    squares = (x**2).sum(1)
    error = 4 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (np.sqrt((rows**2).sum(1)) + np.sqrt(squares.max())) ** 2
    return (rows**2).sum(1)[:, None] - 2 * rows @ x.T + squares, error


class _Pieces(NamedTuple):
    """What a worker knows of the index: pivots, and for each piece its cell, its rows and the cell's radii."""

    pivots: np.ndarray
    cell: np.ndarray
    size: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _placed(reference: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, x, cell, far): each reference with its nearest pivot and the distance to it."""
    held = reference.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = np.concatenate([np.empty(0, np.int64), *(_rough(x[a : a + _ROWS], held.value)[0].argmin(1) for a in range(0, len(x), _ROWS))])
            far = np.sqrt(((x - held.value[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "x", "cell", "far"])

    return reference.mapInArrow(run, "id bigint, x array<double>, cell int, far double")


def _indexed(reference: DataFrame, pivots: np.ndarray, block: int) -> tuple[DataFrame, _Pieces]:
    """References as (id, x, piece), and the pieces."""
    placed = checkpointed(_placed(reference, pivots))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).orderBy("cell").collect()  # a row a pivot
    base, cuts, rows = [0] * len(pivots), [1] * len(pivots), []
    for c in cells:
        base[c["cell"]], cuts[c["cell"]] = len(rows), -(-c["n"] // block)
        rows += [(c["cell"], c["n"] // cuts[c["cell"]], c["least"], c["most"])] * cuts[c["cell"]]
    of = lambda values: F.get(F.lit(values), F.col("cell"))
    piece = (of(base) + F.pmod(F.xxhash64("id"), of(cuts).cast("bigint"))).cast("int")
    return placed.select("id", "x", piece.alias("piece")), _Pieces(pivots, *(np.array(c) for c in zip(*rows)))


def _planned(queries: DataFrame, pieces: _Pieces, k: int) -> DataFrame:
    """(id, x, bar, pieces) of queries (id, x): the pieces of the nearest pivots until they hold k rows, no bar.

    Of queries (id, x, bar, pieces): all other pieces that may hold a row within the bar.
    """
    held = queries.sparkSession.sparkContext.broadcast(pieces)
    begin = "bar" not in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for whole in batches:
            for a in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(a, _ROWS)
                d2, error = _rough(_matrix(batch.column(1)), index.pivots)
                d2, error = d2[:, index.cell], error[:, None]
                if begin:
                    order = np.argsort(d2, axis=1, kind="stable")
                    wanted = np.zeros(d2.shape, bool)
                    np.put_along_axis(wanted, order, np.cumsum(index.size[order], 1) - index.size[order] < k, 1)
                    bar = pa.array(np.full(batch.num_rows, np.inf))
                else:
                    bar = batch.column(2)
                    near, far = np.sqrt(np.maximum(d2 - error, 0)), np.sqrt(np.maximum(d2, 0) + error)
                    bound = np.maximum(np.maximum(near - index.most, index.least - far), 0) * (1 - 1e-9)
                    wanted = bound**2 <= bar.to_numpy()[:, None]
                    seen = batch.column(3)
                    wanted[np.repeat(np.arange(len(seen)), seen.value_lengths().to_numpy()), seen.flatten().to_numpy()] = False
                ends = np.concatenate([[0], np.cumsum(wanted.sum(1))]).astype(np.int32)
                visited = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(wanted)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bar, visited], names=["id", "x", "bar", "pieces"])

    return queries.mapInArrow(run, "id bigint, x array<double>, bar double, pieces array<int>")


def _searched(plan: DataFrame, indexed: DataFrame, k: int, visits: int) -> DataFrame:
    """(id, neighbor, d2): of each piece that a query visits, its k nearest rows within the bar."""
    asked = plan.select("id", "x", "bar", F.explode("pieces").alias("piece"))
    load = F.broadcast(asked.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / visits).cast("int").alias("copies")))  # a row a piece
    asks = asked.join(load, "piece").select("piece", F.pmod(F.xxhash64("id"), F.col("copies").cast("bigint")).cast("int").alias("copy"), F.lit(True).alias("asks"), "id", "x", "bar")
    rows = indexed.join(load, "piece").select("piece", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("asks"), "id", "x", F.lit(0.0).alias("bar"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ids, x = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                some, vectors = part.column(3).to_numpy(), _matrix(part.column(4))
                if not keys[start, 2]:
                    if now != tuple(keys[start, :2]):
                        now, parts = tuple(keys[start, :2]), []
                    parts.append((some, vectors))
                    continue
                if now != tuple(keys[start, :2]):
                    continue
                if parts:
                    ids, x = (np.concatenate(c) for c in zip(*parts))
                    parts = []
                bars, m = part.column(5).to_numpy(), min(k, len(ids))
                for a in range(0, len(some), _ROWS):
                    q, bar = vectors[a : a + _ROWS], bars[a : a + _ROWS]
                    rough, error = _rough(q, x)
                    least = np.minimum(np.partition(rough, m - 1, axis=1)[:, m - 1], bar)
                    # whatever the rounding of the product may hide among the k nearest, with all ties
                    at, near, exact = _first(q, ids, x, ~(rough > (least + error)[:, None]), m)
                    keep = exact <= bar[at]
                    cols = [some[a : a + _ROWS][at[keep]], ids[near[keep]], exact[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "neighbor", "d2"])

    dealt = rows.unionByName(asks).repartition("piece", "copy").sortWithinPartitions("piece", "copy", "asks")
    return dealt.mapInArrow(run, "id bigint, neighbor bigint, d2 double")


def nearest(queries: DataFrame, reference: DataFrame, k: int, block: int = BLOCK, cell: int = CELL, visits: int = VISITS) -> DataFrame:
    """(id, neighbor, d2, rank): the k nearest reference rows of each query by squared distance, ties by id.

    Both sides are (id bigint, x array<double>) without NULLs, ids of queries unique; a row that is on both sides finds
    itself. Pivots are the references with the least hashes, at most PIVOTS.
    """
    queries, reference = queries.select("id", "x"), reference.select("id", "x")
    n = reference.count()
    if not n:
        return queries.sparkSession.createDataFrame([], "id bigint, neighbor bigint, d2 double, rank int")
    pivots = reference.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // cell))).select("x").collect()
    indexed, pieces = _indexed(reference, np.array([r["x"] for r in pivots], np.float64), block)
    order = Window.partitionBy("id").orderBy("d2", "neighbor")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    plan = checkpointed(_planned(queries, pieces, k))
    found = best(_searched(plan, indexed, k, visits))
    if len(pieces.cell) == 1:
        return found
    found = checkpointed(found)
    bars = found.groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.max("d2")).otherwise(float("inf")).alias("bar"))
    rest = checkpointed(_planned(plan.drop("bar").join(bars, "id").select("id", "x", "bar", "pieces"), pieces, k))
    return best(found.drop("rank").unionByName(_searched(rest, indexed, k, visits)))


def features(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, x) of rows with an id: z-scores of the named columns (missing: the median) times their weights."""
    scaled = zscore(df.select("id", *(F.col(c).cast("double").alias(c) for c in weights)), list(weights))
    return scaled.select("id", F.array(*(F.col(c) * w for c, w in weights.items())).alias("x"))


def centred(df: DataFrame, value: str, se: str, by: str, least: int = 30) -> DataFrame:
    """df with value less its group's offset: the group's weighted mean less that of all, for groups of `least` rows or more.

    Weights are 1 / max(se, 1e-4)^2. Rows of no group (NULL) stay as they are.
    """
    w = 1 / F.pow(F.greatest(se, F.lit(1e-4)), 2)
    every = df.agg(weighted_mean(F.col(value), w).alias("__all"))
    groups = df.filter(F.col(by).isNotNull()).groupBy(by).agg(weighted_mean(F.col(value), w).alias("__mean"), F.count(F.lit(1)).alias("__n"))
    offsets = groups.crossJoin(F.broadcast(every)).select(by, F.when(F.col("__n") >= least, F.col("__mean") - F.col("__all")).alias("__off"))
    return df.join(offsets, by, "left").withColumn(value, F.col(value) - F.coalesce("__off", F.lit(0.0))).drop("__off")


def expectation(neighbors: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """Expected value, residual and z of each sample from its k + 1 nearest references (itself has weight 0).

    neighbors: (id, neighbor); samples: (id, value, se). The divisor of the error of the expectation is always k.
    """
    other = samples.select(F.col("id").alias("neighbor"), F.col("value").alias("nv"), F.col("se").alias("ns"))
    rows = neighbors.join(other, "neighbor")
    w = F.when(F.col("neighbor") == F.col("id"), 0.0).otherwise(1 / F.pow(F.greatest("ns", F.lit(1e-4)), 2))
    rows = rows.withColumn("w", w)
    sums = rows.groupBy("id").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("nv")).alias("swv"), F.sum(F.col("w") * F.col("nv") * F.col("nv")).alias("swv2"), F.sum(F.col("w") * F.col("ns") * F.col("ns")).alias("sws"))
    out = samples.join(sums, "id")
    mean = F.col("swv") / F.col("sw")
    var = F.col("swv2") / F.col("sw") - mean * mean
    bio = F.greatest(F.lit(0.0), var - F.col("sws") / F.col("sw"))
    z = (F.col("value") - mean) / F.sqrt(F.col("se") * F.col("se") + bio + F.greatest(F.lit(0.0), var) / k)
    return out.select("id", mean.alias("expected"), (F.col("value") - mean).alias("residual"), z.alias("z"), F.sqrt(bio).alias("sigma_bio"), (F.col("sw") * F.col("sw") / F.col("sw2")).alias("n_eff"))


def _packed(members: DataFrame, pools: int) -> DataFrame:
    """(id, pools) with a bit for each pool: a reference's pools go with each list that it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bits = np.zeros((len(lists), pools), bool)
            bits[np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten().to_numpy()] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["id", "pools"])

    return members.select(F.col("id").cast("bigint"), F.col("pools").cast("array<int>")).mapInArrow(run, "id bigint, pools binary")


def _pool_scores(near: DataFrame, samples: DataFrame, k: int, pools: int) -> DataFrame:
    """(id, pool, z, met) from (id, neighbor, rank, pools): each pool's k + 1 first neighbours; met: how many it had.

    pools: as _packed() gives them.
    """
    other = samples.select(F.col("id").alias("neighbor"), F.col("value").alias("nv"), F.col("se").alias("ns"))
    row = F.struct("rank", (F.col("neighbor") == F.col("id")).alias("own"), "nv", "ns", "pools")
    lists = near.join(other, "neighbor").groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("x")).join(samples, "id")
    lists = lists.select("id", "value", "se", *(F.col(f"x.{c}").alias(c) for c in ("own", "nv", "ns", "pools")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, zs, met = [], [], []
            for r in range(batch.num_rows):
                i, value, se, own, nv, ns, member = (c[r] for c in batch.columns)
                nv, ns, member = nv.values.to_numpy(), ns.values.to_numpy(), b"".join(member.values.to_pylist())
                in_pool = np.unpackbits(np.frombuffer(member, np.uint8).reshape(len(nv), -1), axis=1, count=pools).view(bool)
                in_pool &= np.cumsum(in_pool, 0) <= k + 1
                w = np.where(own.values.to_numpy(zero_copy_only=False), 0.0, 1 / np.maximum(ns, 1e-4) ** 2)[:, None] * in_pool
                with np.errstate(invalid="ignore", divide="ignore"):
                    sw = w.sum(0)
                    mean = (w * nv[:, None]).sum(0) / sw
                    var = (w * (nv[:, None] - mean) ** 2).sum(0) / sw
                    bio = np.maximum(0, var - (w * ns[:, None] ** 2).sum(0) / sw)
                    z = (value.as_py() - mean) / np.sqrt(se.as_py() ** 2 + bio + var / k)
                ids.append(np.full(pools, i.as_py()))
                zs.append(z)
                met.append(in_pool.sum(0))
            if ids:
                cols = [np.concatenate(ids), np.tile(np.arange(pools, dtype=np.int32), len(ids)), np.concatenate(zs), np.concatenate(met).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in cols], names=["id", "pool", "z", "met"])

    return lists.mapInArrow(run, "id bigint, pool int, z double, met int")


def pool_scores(queries: DataFrame, reference: DataFrame, samples: DataFrame, members: DataFrame, k: int, pools: int, ahead: int = 4) -> DataFrame:
    """(id, pool, z): what expectation() gives for each pool of references, all pools from one search.

    members: (id, pools), the numbers of the pools (0 .. pools - 1) that a reference belongs to. The search keeps
    ahead * (k + 1) neighbours of each query, enough for pools of a fair share of the references; queries for which a
    pool has fewer than k + 1 of them, while there are more references, are searched again with four times as many. z is
    NULL where a pool has no neighbour of positive weight.
    """
    n, out = reference.count(), None
    members = checkpointed(_packed(members, pools))
    keep = ahead * (k + 1)
    while True:
        near = nearest(queries, reference, keep).join(members.select(F.col("id").alias("neighbor"), "pools"), "neighbor")
        found = checkpointed(_pool_scores(near, samples, k, pools))
        short = found.filter(F.col("met") <= k).select("id").distinct() if keep < n else None
        done = found if short is None else found.join(short, "id", "left_anti")
        out = done if out is None else out.union(done)
        if short is None or short.isEmpty():
            return out.select("id", "pool", "z")
        queries, keep = checkpointed(queries.join(short, "id", "left_semi")), 4 * keep
