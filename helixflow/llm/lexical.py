"""Ranked lexical search: the k best documents of each item, by MaxScore over the inverted lists of shards.

A term's weight is w = floor(1000 ln((2N+2)/(2df+1))), a posting's factor (10^9 tf) div (1000 tf + 12 m) with
m = 100-25 + (25 n N) div L; N, L, df, n and tf are those of the whole table. Weights and factors are 64-bit integers, so
scores are exact and don't depend on the order of sums.

index() reads the documents once, without a shuffle, and writes one row a shard: its documents, their lengths, and the
inverted lists of the terms that are asked for. Counts of the whole table are sums over the shards. In a shard, an item's
terms are taken by falling upper bound (its weight times the shard's largest factor). The kth best score so far, in this
shard or an earlier one of the same task, is the bar. As soon as the bounds of the terms left add up to less than the bar,
these are non-essential: no new document is taken from their lists, and each is probed only for those documents whose
score and the bounds left still reach the bar. Each task gives its k best documents an item; a window over these gives the
answer, which is exact.

Items come in blocks of at most ITEM_BYTES of text, which are broadcast; each further block reads the documents again, so
what a task holds never grows with either table.

Defined results: null texts have no terms. Texts of rows that share an item id (null included) count as one item. Rows of
documents are told apart as rows: repeated ids are separate documents, a null id is one too (after the others among equal
scores). Texts of any length are read whole. Items or documents without terms, and empty tables, give no rows. Other
columns are not used. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, materialize, text_chunks

K = 20
#: Documents a shard.
SHARD_DOCS = 1 << 14
#: Text of items searched at once.
ITEM_BYTES = 1 << 23

#: Bytes of terms: digits, letters and all of UTF-8's beyond ASCII.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_SHARD = "n_docs bigint, n_terms bigint, doc_id array<bigint>, doc_terms binary, term array<bigint>, df array<bigint>, place binary, tf binary"
_FOUND = "item bigint, doc_id bigint, score bigint"


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, terms a row, hashes of all terms in order) for chunks of rows."""
    for first, data, offsets in text_chunks(column):
        words = Words(data, offsets, _IN_TERM)
        yield first, np.diff(words.row_words), words.hashes().view(np.int64)


class _Shard:
    """The documents and postings of a shard while it fills."""

    def __init__(self):
        self.ids, self.sizes, self.postings, self.n = [], [], [], 0

    def add(self, ids: list, sizes: np.ndarray, hashes: np.ndarray, asked: np.ndarray) -> None:
        at = np.searchsorted(asked, hashes)
        at[at == len(asked)] = 0
        hit = asked[at] == hashes if len(asked) else np.zeros(len(hashes), bool)
        row = np.repeat(np.arange(self.n, self.n + len(sizes)), sizes)[hit]
        key, tf = np.unique(at[hit] * np.int64(1 << 32) + row, return_counts=True)
        self.postings.append((key, tf))
        self.ids += ids
        self.sizes.append(sizes)
        self.n += len(sizes)

    def record(self, asked: np.ndarray) -> pa.RecordBatch:
        sizes = np.concatenate(self.sizes)
        key, tf = (np.concatenate(x) for x in zip(*self.postings))
        by = np.argsort(key, kind="stable")
        key, tf = key[by], tf[by]
        term, df = np.unique(key >> 32, return_counts=True)
        cols = [
            [int((sizes > 0).sum())], [int(sizes.sum())], [self.ids], [sizes.astype(np.int64).tobytes()],
            [asked[term]], [df], [(key & 0xFFFFFFFF).astype(np.int32).tobytes()], [tf.astype(np.int32).tobytes()],
        ]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), pa.int64(), longs, pa.binary(), longs, longs, pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _SHARD.split(", ")])


def index(docs: DataFrame, asked, id_col: str = "doc_id", text_col: str = "text", *, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Shards of docs as rows, with inverted lists of the terms whose hashes are in the broadcast array asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, sizes, hashes in _terms(batch.column(1)):
                shard.add(ids[first : first + len(sizes)], sizes, hashes, asked.value)
                if shard.n >= shard_docs:
                    yield shard.record(asked.value)
                    shard = _Shard()
        if shard.n:
            yield shard.record(asked.value)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, _SHARD)


class Searcher:
    """MaxScore over shards, one after the other; best holds each item's k best (score, document) so far."""

    def __init__(self, items: list[dict[int, int]], weight: dict[int, int], n: int, total: int, k: int):
        self.n, self.total, self.k = n, total, k
        #: (term, the item's multiple of its weight)
        self.items = [[(t, c * weight[t]) for t, c in item.items() if weight.get(t)] for item in items]
        self.best: list[list[tuple]] = [[] for _ in items]
        self.probed = self.postings = 0

    def shard(self, ids: list, sizes: np.ndarray, term: np.ndarray, df: np.ndarray, place: np.ndarray, tf: np.ndarray) -> None:
        m = 75 + (25 * sizes * self.n) // self.total
        tf = tf.astype(np.int64)
        factor = (1_000_000_000 * tf) // (1000 * tf + 12 * m[place])
        ends = np.cumsum(df)
        starts = ends - df
        most = np.maximum.reduceat(factor, starts) if len(starts) else factor[:0]
        lists = {int(t): (int(a), int(b), int(f)) for t, a, b, f in zip(term, starts, ends, most)}
        for i, item in enumerate(self.items):
            here = [(w * lists[t][2], w, *lists[t][:2]) for t, w in item if t in lists]
            if here:
                self._item(i, sorted(here, reverse=True), ids, place, factor)

    def _item(self, i: int, lists: list[tuple], ids: list, place: np.ndarray, factor: np.ndarray) -> None:
        left = sum(x[0] for x in lists)
        best = self.best[i]
        bar = best[-1][0] if len(best) == self.k else 1
        if left < bar:
            return
        score = np.zeros(len(ids), np.int64)
        at = 0
        for bound, w, a, b in lists:  # essential lists
            if left < bar:
                break
            score[place[a:b]] += w * factor[a:b]
            left -= bound
            at += 1
            self.postings += b - a
            if len(score) > self.k:
                bar = max(bar, int(np.partition(score, len(score) - self.k)[len(score) - self.k]))
        # ties count: what just reaches the bar may have the smaller id
        may = np.flatnonzero(score + left >= bar) if at < len(lists) else np.flatnonzero(score >= bar)
        may = may[score[may] > 0]
        for bound, w, a, b in lists[at:]:  # non-essential lists
            if not len(may):
                return
            spot = np.searchsorted(place[a:b], may)
            spot[spot == b - a] = 0
            met = place[a:b][spot] == may
            score[may[met]] += w * factor[a:b][spot[met]]
            self.probed += len(may)
            left -= bound
            if len(may) > self.k:
                bar = max(bar, int(np.partition(score[may], len(may) - self.k)[len(may) - self.k]))
            may = may[score[may] + left >= bar]
        new = [(int(score[d]), ids[d]) for d in may[score[may] >= bar]]
        best += new
        best.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        del best[self.k :]


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """(id, text) of the items in blocks of about most bytes; rows of one id are in one block."""
    held, size, last = [], 0, object()
    for item, text in items.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).sort(id_col).toLocalIterator():
        if held and size + len(text) > most and item != last:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text)
        last = item
    if held:
        yield held


def top_k(docs: DataFrame, items: DataFrame, k: int = K, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_docs: int = SHARD_DOCS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    for block in _blocks(items, item_col, item_text_col, item_bytes):
        names = list(dict.fromkeys(i for i, _ in block))
        row = {name: r for r, name in enumerate(names)}
        counts: list[Counter] = [Counter() for _ in names]
        for first, sizes, hashes in _terms(pa.array([t for _, t in block], pa.string())):
            ends = np.cumsum(sizes)
            for j, (a, b) in enumerate(zip(ends - sizes, ends)):
                counts[row[block[first + j][0]]].update(hashes[a:b].tolist())
        some = _found(docs, [dict(c) for c in counts], k, id_col, text_col, shard_docs)
        named = spark.createDataFrame(list(enumerate(names)), f"item bigint, item_id {kind}")
        some = some.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # names of one block
        out = some if out is None else out.union(some)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def _found(docs: DataFrame, items: list[dict[int, int]], k: int, id_col: str, text_col: str, shard_docs: int) -> DataFrame:
    spark = docs.sparkSession
    asked = spark.sparkContext.broadcast(np.array(sorted(set().union(*items)), np.int64))
    shards = materialize(index(docs, asked, id_col, text_col, shard_docs=shard_docs), "shards")
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    pairs = shards.select(F.explode(F.arrays_zip("term", "df")).alias("x"))
    # at most one row a term of this block of items
    df = dict(pairs.groupBy("x.term").agg(F.sum("x.df")).toLocalIterator())
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    plan = spark.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for r in range(batch.num_rows):
                search = search or Searcher(*plan.value, n, total, k)
                ids, sizes, term, count, place, tf = (batch.column(c)[r] for c in range(6))
                search.shard(
                    ids.as_py(), np.frombuffer(sizes.as_buffer(), np.int64), term.values.to_numpy(), count.values.to_numpy(),
                    np.frombuffer(place.as_buffer(), np.int32), np.frombuffer(tf.as_buffer(), np.int32),
                )
        if search:
            rows = [(i, d, s) for i, best in enumerate(search.best) for s, d in best]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "doc_id", "score"])

    found = shards.select("doc_id", "doc_terms", "term", "df", "place", "tf").mapInArrow(run, _FOUND)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
