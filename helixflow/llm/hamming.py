"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become codes of BITS bits, one for the sign of each of the first BITS coordinates. Rows are indexed part by
part: a part (at most PART_ROWS rows) keeps, for each of the code's segments, its rows in the order of the segment's
value. Queries come in blocks of at most BLOCK, which are broadcast; each part answers each query with its own best k,
and an aggregate merges the parts' answers.

In a part, the search radius of the segments grows from 0. When all segments have been probed up to radius r, each
code within a distance of segments * (r + 1) - 1 has been met (by the pigeonhole principle, one of its segments
differs in at most r bits), so a query stops as soon as its kth distance is at most that. Candidates are verified by
their full distance. The answer is exact: recall against brute force over the codes is 1.

Defined results: rows with a null id, a null vector or a vector of fewer than BITS coordinates have no code; they are
neither found nor queries. Null coordinates and zero count as not negative. Equal distances are ordered by id. A query
finds itself. Repeated ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 64
SEGMENTS = 4
PART_ROWS = 1 << 17
BLOCK = 1 << 15
#: Candidates verified at once.
_AT_ONCE = 1 << 20
RESULT = "query_id bigint, neighbor_id bigint, distance int"


def codes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code) from the signs of the first BITS coordinates."""
    v = F.col(vector_col)
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(F.get(v, i) < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return df.filter(F.col(id_col).isNotNull() & (F.size(v) >= BITS)).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


@cache
def _flips(width: int, radius: int) -> np.ndarray:
    """All segment values with radius bits set."""
    return np.array([sum(1 << b for b in bs) for bs in combinations(range(width), radius)], np.int64)


class Part:
    """A multi-index over some rows."""

    def __init__(self, ids: np.ndarray, code: np.ndarray, segments: int = SEGMENTS):
        by = np.argsort(ids, kind="stable")  # places are then in the order of ids, for ties
        self.ids, self.code = ids[by], code[by].view(np.uint64)
        self.width = BITS // segments
        self.tables = []
        for s in range(segments):
            value = self._segment(self.code, s)
            order = np.argsort(value, kind="stable").astype(np.int32)
            starts = np.zeros((1 << self.width) + 1, np.int64)
            np.cumsum(np.bincount(value, minlength=1 << self.width), out=starts[1:])
            self.tables.append((order, starts))

    def _segment(self, code: np.ndarray, s: int) -> np.ndarray:
        return ((code >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest rows of each code (all, where the part has fewer)."""
        queries = queries.view(np.uint64)
        n, k = len(queries), min(k, len(self.ids))
        # a row's key is its distance, then its place: one number orders both
        best = np.full((n, k), np.iinfo(np.int64).max)
        todo = np.arange(n)
        for radius in range(self.width + 1):
            flips = _flips(self.width, radius)
            for s, (order, starts) in enumerate(self.tables):
                probe = (self._segment(queries[todo], s)[:, None] ^ flips).ravel()
                sizes = starts[probe + 1] - starts[probe]
                ends = np.cumsum(sizes)
                a = 0
                while a < len(probe):  # runs of probes with about _AT_ONCE candidates
                    low = ends[a] - sizes[a]
                    b = max(a + 1, int(np.searchsorted(ends, low + _AT_ONCE, side="right")))
                    size = sizes[a:b]
                    total = int(ends[b - 1] - low)
                    if total:
                        who = np.repeat(todo[np.arange(a, b) // len(flips)], size)
                        at = np.arange(total) - np.repeat(ends[a:b] - size - low, size) + np.repeat(starts[probe[a:b]], size)
                        rows = order[at].astype(np.int64)
                        key = (np.bitwise_count(self.code[rows] ^ queries[who]).astype(np.int64) << 40) | rows
                        self._keep(best, who, key, k)
                    a = b
            # what is within this distance has been met
            covered = len(self.tables) * (radius + 1) - 1
            todo = todo[best[todo, -1] >> 40 > covered]
            if not len(todo):
                break
        return best & ((1 << 40) - 1), best >> 40

    @staticmethod
    def _keep(best: np.ndarray, who: np.ndarray, key: np.ndarray, k: int) -> None:
        """Puts the candidates into best, a row of k ascending keys for each query; a row met again counts once."""
        good = key < best[who, -1]
        who, key = who[good], key[good]
        if not len(who):
            return
        by = np.lexsort((key, who))
        who, key = who[by], key[by]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])
        who, key = who[fresh], key[fresh]
        starts = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(starts, np.diff(starts, append=len(who)))
        few = rank < k
        qs, row = np.unique(who[few], return_inverse=True)
        new = np.full((len(qs), 2 * k), np.iinfo(np.int64).max)
        new[:, :k] = best[qs]
        new[row, k + rank[few]] = key[few]
        new.sort(1)
        again = np.zeros(new.shape, bool)
        again[:, 1:] = (new[:, 1:] == new[:, :-1]) & (new[:, 1:] < np.iinfo(np.int64).max)
        new[again] = np.iinfo(np.int64).max
        new.sort(1)
        best[qs] = new[:, :k]


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list = []
    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            held = []
    if held:
        yield np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, *, segments: int = SEGMENTS, part_rows: int = PART_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the k rows nearest to each query; both sides are (id, code)."""
    from pyspark.sql import Window

    spark = rows.sparkSession

    def answers(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def full(held_ids: list, held_codes: list) -> Iterator[pa.RecordBatch]:
                part = Part(np.concatenate(held_ids), np.concatenate(held_codes), segments)
                ids, code = held.value
                for a in range(0, len(ids), 1024):
                    places, distance = part.search(code[a : a + 1024], k)
                    cols = [np.repeat(ids[a : a + 1024], places.shape[1]), part.ids[places.ravel()], distance.ravel().astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "neighbor_id", "distance"])

            ids, code, n = [], [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids.append(batch.column(0).to_numpy())
                code.append(batch.column(1).to_numpy())
                n += batch.num_rows
                if n >= part_rows:
                    yield from full(ids, code)
                    ids, code, n = [], [], 0
            if n:
                yield from full(ids, code)

        found = rows.mapInArrow(run, RESULT)
        near = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
        return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)

    out = None
    for part in _blocks(queries, block):
        some = materialize(answers(spark.sparkContext.broadcast(part)), "answers")
        out = some if out is None else out.union(some)
    return out if out is not None else spark.createDataFrame([], RESULT + ", rank int")
