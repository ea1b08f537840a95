"""LM scoring: a causal self-attention model over subword ids, and the unigram base score.

Texts are words (A-Z lower-cased), each with one space before it, and one end; words and the end are the tokens. Words
are cut by a public byte-level tokenizer, word by word, so a text's ids spell the text and nothing else.

The model: the probability of a token is that of its class, which attention gives from the subword ids of the tokens
before it, times its share of the class. A word's class is that of its longest subword. A word of the training texts
has (1 - e) * count / count of the class; any other has e times the probability of its spelling by subwords, each
given the one before it (the word's class for the first). e is the share of training tokens that occur
once. The shares of a class sum to 1 at most, so scores are log probabilities.

Learning reads every training document, in the same way at every size:
  * counts of all words, by partial counts and one shuffle;
  * classes of subword ids: k-means over which frequent words stand beside the words that they name;
  * spelling counts, from all words that are not frequent: frequent ids after frequent ids, and after classes of ids;
  * attention: each document takes part in one of the rounds, so all are read once; the tasks of a round start from
    the same weights, and the mean of what they learn starts the next round.
What grows with the corpus is shuffled; tables of fixed size (ids by classes or by neighbours) are summed in tasks.

Scoring: a worker cuts texts into overlapping windows, each token being scored once, and scores many windows at once
with a causal mask. Word counts are far too many for a broadcast: only words that are at least 1 in HOT of all tokens
(so at most HOT) are looked up in the worker; the others of a text are joined to the counts by hash, and no counted
word holds more than 1 in HOT of the rows. Words are named by 64-bit hashes throughout; two words of one hash would be
counted as one.

Defined results: null text is empty and has one token, the end. A null doc_id counts as the empty text for the fold.
Without training documents N is 0 and words are scored by spelling alone. Repeated rows are separate rows with equal
scores. Ties (equal counts, equal subwords) are ordered by id. Texts of any length are read whole. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .common import Words, materialize, text_chunks

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
HOT = 1_000_000
#: Classes; the first is the end's.
CLASSES = 64
#: Ids with an embedding of their own, and frequent words that count as a neighbour when classes are made.
OWN = 2048
NEIGHBOURS = 63
#: Ids with a column of their own in the spelling table, and two more: a word's end, and all others.
COLUMNS = 4096
#: Weight, in counts, of the shares after an id's class against those after the id, and of all shares against those after a class.
SMOOTH = 20.0
#: Step sizes of the rounds of training.
RATES = (0.02, 0.01, 0.005, 0.0025)
#: Tokens that a training task holds in memory at once.
PIECE_TOKENS = 400_000
#: Tasks that sum the tables of others, and cells of a table that are a row.
SUMS = 8
BLOCK = 1 << 16
#: Rows of texts that are sent to a worker at once.
ROWS_AT_ONCE = 1000
#: Words that a worker remembers.
CACHE = 1 << 18
_PIECE = 64
#: Windows scored at once: few enough for a core's cache.
_BATCH = 128
#: Bytes of new words that are cut into ids at once.
_TEXT = 1 << 20
#: Bytes of text that are hashed at once to be counted: few enough for a core's cache.
_HASHED = 1 << 18
#: Words counted together.
_COUNTED = 1 << 22
_LOG10 = np.log(10)


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Long rows are sent to workers few at a time; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Tokenizer:
    """Ids of words; the id after the last is the end's."""

    _made: dict = {}

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("subwords", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.core = self.encoding._core_bpe
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.begins = Pieces.of(ranks).begins

    @classmethod
    def of(cls, held) -> Tokenizer:
        """The worker's tokenizer for a broadcast of ranks."""
        ranks = held.value
        if cls._made.get("ranks") is not ranks:
            cls._made.update(ranks=ranks, tokenizer=cls(ranks))
        return cls._made["tokenizer"]

    def ids(self, word: bytes) -> list[int]:
        word = b" " + word
        if len(word) <= _PIECE:
            return self.core.encode_single_piece(word)
        return [i for a in range(0, len(word), _PIECE) for i in self.core.encode_single_piece(word[a : a + _PIECE])]

    def runs(self, words: Words, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each word) of runs of the words at which, none of which is longer than _PIECE with its space."""
        starts, longer = words.starts[which], words.ends[which] - words.starts[which] + 1
        ends = np.cumsum(longer)
        a = 0
        while a < len(which):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - longer[a] + _TEXT, side="right")))
            firsts = ends[a:b] - longer[a:b] - (ends[a] - longer[a])
            text = words.data[np.maximum(np.arange(int(longer[a:b].sum())) + np.repeat(starts[a:b] - firsts - 1, longer[a:b]), 0)]
            text[firsts] = 32
            try:
                ids = self.encoding.encode_to_numpy(text.tobytes().decode(), disallowed_special=()).astype(np.int32)
                yield ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))
            except UnicodeDecodeError:  # bytes that are no text
                every = [self.ids(words.text(i)) for i in which[a:b].tolist()]
                yield np.array([i for x in every for i in x], np.int32), np.array([len(x) for x in every])
            a = b


class Pieces(NamedTuple):
    """By id: whether it begins a word, and a number whose largest in a word names the word's longest id (of equal ones, the smallest)."""

    begins: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Pieces:
        begins, order = np.zeros(max(ranks.values()) + 2, bool), np.zeros(max(ranks.values()) + 2, np.int64)
        for piece, i in ranks.items():
            begins[i] = piece[:1] == b" "
            order[i] = (len(piece) << 32) - i
        return cls(begins, order)

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first id, number of ids, longest id) of each word that the ids spell."""
        starts = np.flatnonzero(self.begins[ids])
        if not len(starts):
            return starts, starts, starts
        top = np.maximum.reduceat(self.order[ids], starts)
        return starts, np.diff(starts, append=len(ids)), -top & 0xFFFFFFFF

    @property
    def kind(self) -> np.dtype:
        """The smallest type that holds all ids."""
        return np.min_scalar_type(len(self.begins) - 1)


class Vocabulary:
    """The ids of the words that a worker remembers, by hash."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.starts, self.sizes = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.used = self.count = 0

    def places(self, words: Words, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of distinct words with these hashes, the first of each being at first."""
        if len(self.known) > CACHE:
            self.clear()
        known = self.known
        out = np.fromiter(map(known.get, hashes.tolist(), repeat(-1)), np.int64, len(hashes))
        new = np.flatnonzero(out < 0)
        long = words.ends[first[new]] - words.starts[first[new]] >= _PIECE
        short, long = new[~long], new[long]
        for ids, sizes in self.tokenizer.runs(words, first[short]):
            self._add(ids, sizes)
        for k in long.tolist():
            ids = self.tokenizer.ids(words.text(first[k]))
            self._add(np.array(ids, np.int32), np.array([len(ids)]))
        new = np.concatenate([short, long])
        out[new] = np.arange(len(known), len(known) + len(new))
        known.update(zip(hashes[new].tolist(), out[new].tolist()))
        return out

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Appends words given by their ids and the number of ids of each."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.flat[self.used : self.used + len(ids)] = ids
        n = self.count + len(sizes)
        for name in ("starts", "sizes"):
            while len(getattr(self, name)) < n:
                setattr(self, name, np.concatenate([getattr(self, name)] * 2))
        self.starts[self.count : n], self.sizes[self.count : n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(ids), n

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and where each word's end (with a 0 before the first)."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.starts[places] - (ends - sizes), sizes)]
        return flat, np.concatenate([[0], ends])


class Model(NamedTuple):
    weights: dict[str, np.ndarray]
    pieces: Pieces
    #: For each id: its row of the embeddings and its class.
    row: np.ndarray
    label: np.ndarray
    #: log10 of the count of each class.
    mass: np.ndarray
    spelling: Spelling | None
    #: log10 of the weights of words that were counted and of spellings.
    seen: float
    unseen: float


# ---------------------------------------------------------------- words and ids


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n) over rows of (text): how often each word, named by its hash, occurs."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), _HASHED):
                held.append(Words(data, offsets).hashes())
                n += len(held[-1])
                if n > _COUNTED:
                    yield counted(held)
                    held, n = [], 0
        if n:
            yield counted(held)

    return docs.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


#: Lists travel as bytes, which are copied whole where the elements of arrays are written and read one by one.
_ENCODED = "doc_id bigint, held_out boolean, round int, n_words bigint, known bigint, base double, hot double, ids binary, cold binary, cold_at binary"


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes of these values; ends: where each row's values end, with a 0 before the first."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64) * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of rows that _packed() made of values of this kind."""
    if not len(column):
        return np.empty(0, kind), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def encoded(docs: DataFrame, held_out: Column, often: tuple[np.ndarray, np.ndarray], ranks, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of docs: its ids, sums over its frequent words, and its other words (hash and number).

    known: frequent words; base, hot: sums of their log10(count + 0.1) and log10(count). often: sorted hashes, counts.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(Tokenizer.of(ranks))
        kind = np.min_scalar_type(vocabulary.tokenizer.end)
        keys, counts = frequent.value
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(3)):
                words = Words(data, offsets)
                h, at, every = np.unique(words.hashes(), return_index=True, return_inverse=True)
                flat, ends = vocabulary.ids(vocabulary.places(words, h, at)[every])
                place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hot = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                n = np.where(hot, counts[place], 1) if len(keys) else np.ones(len(h))
                cuts, hot_words = words.row_words, hot[every]
                size = np.diff(cuts)
                owner = np.repeat(np.arange(len(size)), size)
                sums = lambda values: np.bincount(owner, weights=np.where(hot, values, 0.0)[every], minlength=len(size)).astype(np.float64)  # noqa: E731, B023
                known = np.bincount(owner[hot_words], minlength=len(size))
                cold = np.flatnonzero(~hot_words)
                cold_ends = np.concatenate([[0], np.cumsum(size - known)])
                cols = [batch.column(i).slice(first, len(size)) for i in range(3)]
                cols += [pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(sums(np.log10(n + 0.1))), pa.array(sums(np.log10(n)))]
                cols.append(_packed(flat.astype(kind), ends[cuts]))
                cols.append(_packed(h[every[cold]].view(np.int64), cold_ends))
                cols.append(_packed((cold - cuts[owner[cold]]).astype(np.int32), cold_ends))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _ENCODED.split(", ")])

    turn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)), F.lit(len(RATES))).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), turn.alias("round"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _ENCODED)


def _lists(batches: Iterator[pa.RecordBatch], *kinds: np.dtype, at_once: int = PIECE_TOKENS) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For each column of lists of these kinds, (values, lengths) of runs of whole rows with about at_once values in the first column."""
    held: list = []
    n = 0
    for batch in batches:
        columns = [_unpacked(c, kind) for c, kind in zip(batch.columns, kinds)]
        ends = columns[0][1]
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + at_once - n, side="right")) - 1)
            b = min(b, batch.num_rows)
            held.append([(values[to[a] : to[b]], np.diff(to[a : b + 1])) for values, to in columns])
            n += int(ends[b] - ends[a])
            a = b
            if n >= at_once:
                yield [tuple(map(np.concatenate, zip(*c))) for c in zip(*held)]
                held, n = [], 0
    if held:
        yield [tuple(map(np.concatenate, zip(*c))) for c in zip(*held)]


def _total(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of tables of this size, given as rows of _blocks()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(x.as_buffer(), np.float32)
                total[b] = total[b] + x if b in total else x.astype(np.float64)
        for b, x in total.items():
            yield _block(b, x)

    out = np.zeros(size)
    # a block of the tables is summed in one task, which gets a row of it from each task before
    for b, x in parts.repartition(SUMS, "b").mapInArrow(run, "b int, w binary").toLocalIterator():
        part = np.frombuffer(x, np.float32)
        out[b * BLOCK : b * BLOCK + len(part)] += part
    return out


def _few(rows: DataFrame) -> DataFrame:
    """rows in a few tasks for each core: each task makes one table of fixed size."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _block(b: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["b", "w"])


def _blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A flat table as rows of BLOCK cells, but for those of zeros."""
    for b in range(0, -(-len(table) // BLOCK)):
        x = table[b * BLOCK : (b + 1) * BLOCK]
        if x.any():
            yield _block(b, x)


def id_counts(ids: DataFrame, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """How often each id is the longest of a word, and how often it occurs, over rows of (ids)."""
    n = len(pieces.begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * n, np.int64)
        for ((flat, _),) in _lists(batches, pieces.kind):
            total[:n] += np.bincount(pieces.words(flat)[2], minlength=n)
            total[n:] += np.bincount(flat, minlength=n)
        yield from _blocks(total)

    got = _total(_few(ids).mapInArrow(run, "b int, w binary"), 2 * n)
    return got[:n], got[n:]


def neighbours(ids: DataFrame, pieces: Pieces, bucket: np.ndarray) -> np.ndarray:
    """(ids, 2 * (NEIGHBOURS + 1)): how often a word of bucket b stands before (at b) or after a word of this longest id."""
    wide = 2 * (NEIGHBOURS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bucket) * wide, np.int32)
        for ((flat, lengths),) in _lists(batches, pieces.kind):
            starts, _, keys = pieces.words(flat)
            if len(keys) < 2:
                continue
            text = np.repeat(np.arange(len(lengths)), lengths)[starts]
            same = text[1:] == text[:-1]
            before, after = keys[:-1][same], keys[1:][same]
            found, n = np.unique(np.concatenate([after * wide + bucket[before], before * wide + bucket[after] + NEIGHBOURS + 1]), return_counts=True)
            total[found] += n.astype(np.int32)
        yield from _blocks(total)

    return _total(_few(ids).mapInArrow(run, "b int, w binary"), len(bucket) * wide).reshape(-1, wide)


def classes(m: np.ndarray, counts: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """A class (1 .. k - 1) for each id by k-means over the square roots of its neighbours' shares; ids that name no word get the last."""
    label = np.full(len(counts), k - 1, np.int64)
    ids = np.flatnonzero(m.sum(1))
    if not len(ids):
        return label
    m = np.sqrt(m[ids] / m[ids].sum(1)[:, None]).astype(np.float32)
    total = counts[ids].astype(np.float64) + 1
    _, vectors = np.linalg.eigh((m * total[:, None].astype(np.float32)).T @ m)
    z = m @ vectors[:, -32:]
    weight = np.sqrt(total)
    rng = np.random.default_rng(0)
    k = min(k - 2, len(ids))
    centres = z[np.sort(rng.choice(len(ids), k, replace=False, p=weight / weight.sum()))]
    for _ in range(25):
        who = ((centres**2).sum(1) - 2 * z @ centres.T).argmin(1)
        sums, mass = np.zeros((k, z.shape[1])), np.bincount(who, weights=weight, minlength=k)
        np.add.at(sums, who, z * weight[:, None])
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres).astype(np.float32)
    label[ids] = who + 1
    return label


class Spelling(NamedTuple):
    """Shares of ids after the id before. Rows: ids with an embedding of their own, classes of the others, classes of words (for their first id)."""

    row: np.ndarray
    #: For each id, and last for a word's end: the column, and log10 of the share of the column.
    column: np.ndarray
    within: np.ndarray
    #: log10 shares of the columns in each row.
    share: np.ndarray | None

    @classmethod
    def empty(cls, row: np.ndarray, by_id: np.ndarray) -> Spelling:
        """The most frequent ids have columns of their own; the others share the last."""
        weight = np.append(by_id + 0.5, 1.0)
        column = np.full(len(weight), COLUMNS - 1)
        own = np.argsort(-by_id, kind="stable")[: COLUMNS - 2]
        column[own], column[-1] = np.arange(len(own)), COLUMNS - 2
        rest = np.bincount(column, weights=weight, minlength=COLUMNS)
        return cls(row, column, np.log10(weight / rest[column]), None)

    def runs(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place of each word, row, id) of the ids and the ends of words with the classes own."""
        end = len(self.row)
        longer = sizes + 1
        firsts = np.cumsum(longer) - longer
        at = np.arange(int(longer.sum())) + np.repeat(starts - firsts, longer)
        ids = flat[np.minimum(at, max(0, len(flat) - 1))].astype(np.int64)
        ids[firsts + sizes] = end
        before = np.concatenate([[0], self.row[np.minimum(ids[:-1], end - 1)]]) if len(ids) else ids
        before[firsts] = OWN + CLASSES + own
        return firsts, before, ids

    def log_p(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 of the shares of words of the classes own."""
        if not len(starts):
            return np.empty(0)
        firsts, before, ids = self.runs(flat, starts, sizes, own)
        return np.add.reduceat(self.share[before, self.column[ids]] + self.within[ids], firsts, dtype=np.float64)


def spelled(rows: DataFrame, pieces: Pieces, label: np.ndarray, spelling: Spelling) -> Spelling:
    """spelling with shares from the cold words of rows of (ids, cold_at)."""
    tall = OWN + 2 * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tall * COLUMNS, np.int32)
        for (flat, lengths), (at, some) in _lists(batches, pieces.kind, np.dtype(np.int32)):
            starts, sizes, keys = pieces.words(flat)
            text = np.repeat(np.arange(len(lengths)), lengths)[starts]
            cold = np.repeat(np.searchsorted(text, np.arange(len(lengths))), some) + at
            _, before, ids = spelling.runs(flat, starts[cold], sizes[cold], label[keys[cold]])
            found, n = np.unique(before * COLUMNS + spelling.column[ids], return_counts=True)
            total[found] += n.astype(np.int32)
        yield from _blocks(total)

    counts = _total(_few(rows).mapInArrow(run, "b int, w binary"), tall * COLUMNS).reshape(tall, COLUMNS)
    alone = counts.sum(0) + 0.5
    alone /= alone.sum()
    # the class of each row; an id's own shares are smoothed with those of its class, and these with the shares of all
    kind = np.arange(tall) - OWN
    kind[:OWN] = CLASSES - 1
    kind[spelling.row[spelling.row < OWN]] = label[np.flatnonzero(spelling.row < OWN)]
    by_class = np.zeros((2 * CLASSES, COLUMNS))
    np.add.at(by_class, kind, counts)
    by_class = (by_class + SMOOTH * alone) / (by_class.sum(1)[:, None] + SMOOTH)
    return spelling._replace(share=np.log10((counts + SMOOTH * by_class[kind]) / (counts.sum(1)[:, None] + SMOOTH)).astype(np.float32))


def _tokens(model: Model, flat: np.ndarray, lengths: np.ndarray) -> tuple[attention.Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts (words, then an end each, then one end more), their classes, texts' lengths in tokens; words' starts, sizes and places."""
    end = len(model.label) - 1
    starts, sizes, keys = model.pieces.words(flat)
    text = np.repeat(np.arange(len(lengths)), lengths)[starts]
    count = np.bincount(text, minlength=len(lengths))
    place = np.arange(len(starts)) + text
    n = len(starts) + len(lengths) + 1
    first, size, label = np.full(n, len(flat)), np.ones(n, np.int64), np.zeros(n, np.int64)
    first[place], size[place], label[place] = starts, sizes, model.label[keys]
    rows = np.append(model.row[flat], model.row[end])
    return attention.Tokens(rows, first, size), label, count + 1, starts, sizes, place


def _trained(rows: DataFrame, model: Model) -> Model:
    """The model after the rounds of training, each over its part of the rows of (ids, round)."""
    spark = rows.sparkSession
    weights = model.weights
    names = sorted(weights)
    for number, rate in enumerate(RATES):
        held = spark.sparkContext.broadcast(model._replace(weights=weights, spelling=None))

        def run(batches: Iterator[pa.RecordBatch], held=held, rate=rate, number=number) -> Iterator[pa.RecordBatch]:
            m = held.value
            new, mass, piece = m.weights, 0.0, 0
            for ((flat, lengths),) in _lists(batches, m.pieces.kind):
                t, label, sizes, *_ = _tokens(m, flat, lengths)
                at, y, weight, _ = attention.padded(np.arange(len(label) - 1), sizes, len(label) - 1, overlap=0)
                new, _ = attention.train(new, t, at, label[y], weight.astype(np.float32), rate, seed=number + len(RATES) * piece)
                mass, piece = mass + float(weight.sum()), piece + 1
            if piece:
                yield from _blocks(np.append(np.concatenate([new[k].ravel() for k in names]).astype(np.float64) * mass, mass))

        every = sum(x.size for x in weights.values())
        total = _total(rows.filter(F.col("round") == number).select("ids").mapInArrow(run, "b int, w binary"), every + 1)
        if not total[-1]:
            continue
        mean, at = (total[:-1] / total[-1]).astype(np.float32), 0
        new = {}
        for k in names:
            new[k] = mean[at : at + weights[k].size].reshape(weights[k].shape)
            at += weights[k].size
        weights = new
    return model._replace(weights=weights)


class Learned(NamedTuple):
    model: Model
    counts: DataFrame
    #: All rows of docs, training or not, as encoded() gives them.
    rows: DataFrame
    train_tokens: int
    distinct: int
    ends: int


def learn(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> Learned:
    """Learns from the rows of docs where training holds, and encodes all rows."""
    with _small_batches(docs.sparkSession):
        return _learned(docs, training, id_col, text_col, tokenizer)


def _learned(docs: DataFrame, training: Column, id_col: str, text_col: str, tokenizer: str) -> Learned:
    spark = docs.sparkSession
    by_rank = load_ranks(tokenizer)
    ranks, pieces = spark.sparkContext.broadcast(by_rank), Pieces.of(by_rank)
    end = len(pieces.begins) - 1
    learning = F.coalesce(training, F.lit(False))
    counts = materialize(word_counts(docs.filter(learning).select(text_col)), "words")
    ends = docs.filter(learning).select(id_col).count()
    n, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    often = counts.filter(F.col("n") * HOT >= int(n)).toArrow()  # at most HOT rows
    h, c = often.column("h").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(h)
    rows = materialize(encoded(docs, ~learning, (h[order], c[order]), ranks, id_col, text_col), "encoded")
    texts = rows.filter(~F.col("held_out"))
    by_key, by_id = id_counts(texts.select("ids"), pieces)
    ranked = np.argsort(-by_key, kind="stable")
    bucket = np.full(end + 1, NEIGHBOURS, np.int64)
    bucket[ranked[:NEIGHBOURS]] = np.arange(NEIGHBOURS)
    label = classes(neighbours(texts.select("ids"), pieces, bucket), by_key)
    label[end] = 0
    row = label + OWN
    row[ranked[:OWN]] = np.arange(min(OWN, len(ranked)))
    spelling = spelled(texts.select("ids", "cold_at"), pieces, label, Spelling.empty(row, by_id))
    mass = np.bincount(label, weights=by_key, minlength=CLASSES)
    rare = min(0.5, max(once, 1) / max(int(n), 2))
    model = Model(attention.initial(OWN + CLASSES, CLASSES), pieces, row.astype(np.int32), label, np.log10(np.maximum(mass, 1)), spelling, float(np.log10(1 - rare)), float(np.log10(rare)))
    model = _trained(texts.select("ids", "round"), model)
    return Learned(model, counts, rows, int(n) + ends, int(distinct) + bool(ends), ends)


# ---------------------------------------------------------------- scoring


def score_texts(model: Model, flat: np.ndarray, lengths: np.ndarray, cold: np.ndarray, cold_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts given by their ids: log10 probabilities but for the counts of words, and for each cold word what to add if it was counted.

    Frequent words lack log10 of their count. Cold words (numbers within their texts) are taken as not counted; one
    that was adds its value here and log10 of its count.
    """
    t, label, sizes, starts, word_sizes, place = _tokens(model, flat, lengths)
    out = np.zeros(len(lengths))
    at, y, weight, owner = attention.padded(np.arange(len(label) - 1), sizes, len(label) - 1)
    for a in range(0, len(at), _BATCH):
        s = slice(a, a + _BATCH)
        x = attention.means(model.weights["embed"], t, at[s].ravel()).reshape(*at[s].shape, -1)
        p = attention.class_log_p(model.weights, x, label[y[s]], weight[s])
        out += np.bincount(owner[s], weights=p.sum(1, dtype=np.float64) / _LOG10, minlength=len(out))
    text = place - np.arange(len(place))
    counted = model.seen - model.mass[label[place]]
    firsts = np.searchsorted(text, np.arange(len(lengths)))
    which = np.repeat(firsts, cold_sizes) + cold
    more = counted[which] - model.unseen - model.spelling.log_p(flat, starts[which], word_sizes[which], label[place[which]])
    out += np.bincount(text, weights=counted, minlength=len(out)) - np.bincount(text[which], weights=more, minlength=len(out))
    return out, more


_SCORED = "row bigint, doc_id bigint, held_out boolean, n_words bigint, known bigint, base double, score double, cold array<bigint>, more array<float>"


def score(learned: Learned) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row that was encoded."""
    n, v, ends = learned.train_tokens, learned.distinct, learned.ends
    model = learned.rows.sparkSession.sparkContext.broadcast(learned.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = _unpacked(batch.column("ids"), model.value.pieces.kind)
            cold, ends_of = _unpacked(batch.column("cold"), np.dtype(np.int64))
            cold_at, _ = _unpacked(batch.column("cold_at"), np.dtype(np.int32))
            a = 0
            while a < batch.num_rows:
                b = min(batch.num_rows, max(a + 1, int(np.searchsorted(sizes, sizes[a] + PIECE_TOKENS, side="right")) - 1))
                some = slice(ends_of[a], ends_of[b])
                p, more = score_texts(model.value, ids[sizes[a] : sizes[b]], np.diff(sizes[a : b + 1]), cold_at[some], np.diff(ends_of[a : b + 1]))
                p += batch.column("hot").slice(a, b - a).to_numpy()
                lists = pa.array((ends_of[a : b + 1] - ends_of[a]).astype(np.int32))
                cols = [batch.column(k).slice(a, b - a) for k in ("row", "doc_id", "held_out", "n_words", "known", "base")]
                cols += [pa.array(p), pa.ListArray.from_arrays(lists, pa.array(cold[some])), pa.ListArray.from_arrays(lists, pa.array(more.astype(np.float32)))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCORED.split(", ")])
                a = b

    rows = learned.rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "n_words", "known", "base", "hot", "ids", "cold", "cold_at")
    with _small_batches(rows.sparkSession):
        rows = materialize(rows.mapInArrow(run, _SCORED), "scored")
    counted = learned.counts.select("h", "n")
    words = rows.select("row", F.explode(F.arrays_zip("cold", "more")).alias("w")).select("row", F.col("w.cold").alias("h"), F.col("w.more").alias("more"))
    found = words.join(counted.hint("merge"), "h").groupBy("row").agg(F.sum(F.log10(F.col("n") + 0.1)).alias("s"), F.sum(F.col("more") + F.log10("n")).alias("m"), F.count(F.lit(1)).alias("k"))
    out = rows.drop("cold", "more").withColumn("n_cold", F.col("n_words") - F.col("known")).join(found.hint("merge"), "row", "left")
    k, tokens = F.coalesce("k", F.lit(0)), F.col("n_words") + 1
    base = F.col("base") + F.coalesce("s", F.lit(0.0)) - (F.col("n_cold") - k) + float(np.log10(ends + 0.1)) - tokens * float(np.log10(n + 0.1 * (v + 1)))
    known = F.col("known") + k + int(ends > 0)
    return out.select("doc_id", "held_out", tokens.alias("n_tokens"), known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("m", F.lit(0.0))).alias("score"))
