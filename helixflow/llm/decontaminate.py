"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of each benchmark item (an item of fewer words is one pattern).
Patterns of one length form a class with its own tables. A block is a pair of words (one word where patterns have one
word). SHIFT tells for a block how far the window can move without passing an occurrence; blocks that stand in no
pattern allow the longest move. Where it is 0, the patterns that end in the block are candidates, picked by their
first block, and compared word by word.

The benchmark is read in chunks of at most chunk_bytes of text, each broadcast and searched in a pass of its own, so
what a worker holds is bounded whatever the benchmark's size.

Defined results: null and empty texts have no words and no hits; null items and items without words are never found;
equal windows of several items count for each of them; repeated item ids count once.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, strings, with_arrays, with_schema

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
CHUNK_BYTES = 8 << 20


def words(text: str | None) -> list[str]:
    """Words of text with A-Z (and nothing else) in lower case."""
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []


class Class:
    """Tables for patterns of m words."""

    def __init__(self, m: int, patterns: dict[tuple[str, ...], list[int]]):
        self.m, self.block = m, min(2, m)
        shift: dict = {}
        self.bucket: dict = {}
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = p[end - 2 : end] if self.block == 2 else p[end - 1]
                shift[key] = min(shift.get(key, m), m - end)
            self.bucket.setdefault(key, {}).setdefault(p[: self.block], []).append((list(p), items))
        self.first: dict = {}
        if self.block == 2:
            for (a, b), s in shift.items():
                self.first.setdefault(a, {})[b] = s
        else:
            self.first = shift

    def search(self, ws: list[str], hits: list[tuple[int, int]], items: set[int]) -> None:
        """Adds (start, end) of each occurrence to hits, and the items that have it."""
        m, first, far, at, n = self.m, self.first, self.m - self.block + 1, self.m - 1, len(ws)
        none: dict = {}
        while at < n:
            if self.block == 2:
                move = first.get(ws[at - 1], none).get(ws[at], far)
            else:
                move = first.get(ws[at], far)
            if move:
                at += move
                continue
            start = at - m + 1
            key = (ws[at - 1], ws[at]) if self.block == 2 else ws[at]
            for p, who in self.bucket[key].get(tuple(ws[start : start + self.block]), ()):
                if ws[start : at + 1] == p:
                    hits.append((start, at + 1))
                    items.update(who)
            at += 1


class Searcher:
    """Wu-Manber tables for (item, text) pairs; items are numbered in their order."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        by_length: dict[int, dict] = {}
        for i, text in enumerate(texts):
            ws = words(text)
            m = min(window, len(ws))
            for at in range(len(ws) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(ws[at : at + m]), []).append(i)
        self.classes = [Class(m, p) for m, p in sorted(by_length.items())]

    def __call__(self, ws: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        for c in self.classes:
            c.search(ws, hits, items)
        return hits, items


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: The last tables that this worker built.
_ready: dict = {}

RESULT = "n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, chunk_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's (id, text) rows in runs of about chunk_bytes (more only where one item is longer)."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), text_col).distinct()
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > chunk_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    yield held


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with n_words, hits (merged word ranges of occurring windows) and items (ids, sorted as strings).

    Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "hits", "items")
    for k, chunk in enumerate(_chunks(benchmark, item_col, item_text_col, chunk_bytes)):
        if k:
            out = materialize(out, "hits")
        out = _pass(out, spark.sparkContext.broadcast(chunk), text_col, window, more=bool(k))
    return out


def _pass(docs: DataFrame, chunk, text_col: str, window: int, more: bool) -> DataFrame:
    """One search for the items of a chunk; more: what earlier passes found is kept."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ready:
            _ready.clear()
            _ready[key] = Searcher([t for _, t in chunk.value], window)
        search, ids = _ready[key], [i for i, _ in chunk.value]
        for batch in batches:
            counts, ranges, names = [], [], []
            old = (batch.column("hits").to_pylist(), batch.column("items").to_pylist()) if more else None
            for k, text in enumerate(strings(batch.column(text_col))):
                ws = words(text)
                hits, items = search(ws)
                found = {ids[i] for i in items}
                if old:
                    hits += [(x["start"], x["end"]) for x in old[0][k]]
                    found.update(old[1][k])
                counts.append(len(ws))
                ranges.append([{"start": a, "end": b} for a, b in merged(hits)])
                names.append(sorted(found))
            yield with_arrays(batch, {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(ranges, _HITS), "items": pa.array(names, pa.list_(pa.string()))})

    return docs.mapInArrow(run, with_schema(docs, RESULT))


def contaminated(min_share: int = 20):
    """At least one word is hit, and min_share times as many as the document has words are."""
    hit = n_hit()
    return (hit > 0) & (hit * min_share >= F.col("n_words"))


def n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def items_sha256():
    return F.sha2(F.concat_ws(",", "items").cast("binary"), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
