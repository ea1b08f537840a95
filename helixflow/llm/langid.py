"""Language ID: an interpolated Kneser-Ney character model for each language, in sorted hash arrays.

Texts are lower-cased and cut into runs of letters; marks, digits and white space only separate. Models are of order
4 and read each run by itself, between spaces, so a worker scores a run once and keeps its sums (at most CACHE runs). The n-grams of all languages share one sorted array of hashes for each order, beside
a matrix of log probabilities with a column for each language, so one binary search serves all languages. What is not
in the table of an order backs off with the context's weight. A text gets the language of the lowest cross-entropy a
character; equal ones go to the first language in code-point order.

Rejection: a text's margin is by how many bits a character its best language model beats a model of single characters
over all languages. A text whose margin is under the threshold is rejected. The threshold is 0, or lower if more than
1 in 1,000 held-back training texts would be rejected then.

Bound: the models are fitted on about max_docs training texts for each language, picked by a hash of the key (all
of them where there are fewer), each read whole; one in CALIBRATE of these is held back for the threshold. All their
n-grams are kept; what is broadcast grows with the languages, not with the corpus.

Defined results: null texts and texts without a letter are `und`, score 0, rejected; with nothing to learn from, all
texts are `und` and rejected. Rows are judged alone, so repeated rows get the same result. Texts of any length are read
whole. An empty table gives an empty result; columns of these names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import strings, with_arrays, with_schema

ORDER = 4
MAX_DOCS = 1500
NONE = "und"
#: Texts of the sample that are held back for the threshold: one in CALIBRATE.
CALIBRATE = 5
QUANTILE = 0.001
#: Bits a character are multiplied by this for the score.
SHARPNESS = 12.0
_RUNS = re.compile(r"[^\W\d_]+")
_R = np.uint64(0x9E3779B97F4A7C15)
#: Characters scored at once, and runs of letters that a worker remembers.
_CHUNK = 1 << 16
CACHE = 1 << 16
#: Rows whose texts are Python strings at once.
_ROWS = 512
_PAD = " " * (ORDER - 1)


def runs_of(text: str) -> list[str]:
    """Runs of letters (and of numerals that count as word characters), lower-cased."""
    return _RUNS.findall(text.lower())


def stream(run: str) -> str:
    """What the models read of a run; empty if it has no letter."""
    return f"{_PAD}{run} " if run.isalpha() or any(map(str.isalpha, run)) else ""


def _hash(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at order - 1, order, ... of codes (uint64)."""
    n = len(codes) - order + 1
    h = codes[:n].copy()
    for i in range(1, order):
        h *= _R
        h += codes[i : n + i]
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Model(NamedTuple):
    langs: list[str]
    #: For each order 1 .. ORDER: sorted hashes, log2 probabilities (rows: n-grams, columns: languages).
    grams: list[tuple[np.ndarray, np.ndarray]]
    #: For each order: sorted hashes of the contexts (one character less), log2 of the weights of lower orders.
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float
    background: tuple[np.ndarray, np.ndarray]
    threshold: float


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of h in keys, and where they are there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return at, keys[at] == h


def fit(counts: dict[str, Counter]) -> Model:
    """Kneser-Ney models from counts of ORDER-grams for each language."""
    langs = sorted(counts)
    levels = [counts]
    for _ in range(ORDER - 1):  # counts of distinct left extensions
        levels.insert(0, {k: Counter(g[1:] for g in c) for k, c in levels[0].items()})
    alphabet = sorted({g for c in levels[0].values() for g in c})
    unseen = 1.0 / (len(alphabet) + 1)
    lower: dict[str, np.ndarray] = {}
    grams, contexts = [], []
    for order, level in enumerate(levels, 1):
        names = sorted(set().union(*level.values()))
        before = sorted({g[:-1] for g in names})
        place = {g: i for i, g in enumerate(before)}
        c = np.array([[level[k].get(g, 0) for k in langs] for g in names], np.float64).reshape(len(names), len(langs))
        ctx = np.array([place[g[:-1]] for g in names], np.int64)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        cut = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        cut = np.clip(cut, 0.1, 0.95)
        total, kinds = np.zeros((len(before), len(langs))), np.zeros((len(before), len(langs)))
        np.add.at(total, ctx, c)
        np.add.at(kinds, ctx, c > 0)
        weight = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
        rest = np.array([lower[g[1:]] for g in names]).reshape(len(names), len(langs)) if order > 1 else unseen
        p = np.maximum(c - cut, 0) / np.maximum(total[ctx], 1) + weight[ctx] * rest
        lower = dict(zip(names, p))
        for out, keys, values in ((grams, names, p), (contexts, before, weight)):
            h = np.array([int(_hash(_codes(g), len(g))[0]) if g else 0 for g in keys], np.uint64)
            by = np.argsort(h)
            out.append((h[by], np.log2(values[by]).astype(np.float32)))
    one: Counter = Counter()
    for c in counts.values():
        for g, n in c.items():
            one[g[-1]] += n
    total = sum(one.values()) + len(one) + 1
    chars = sorted(one, key=ord)
    background = (np.array([ord(x) for x in chars], np.uint64), np.log2(np.array([(one[x] + 1) / total for x in chars])).astype(np.float32))
    return Model(langs, grams, contexts, float(np.log2(unseen)), background, 0.0)


def _log_p(model: Model, codes: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """log2 probabilities, for each language, of the characters at ends after the order - 1 before them."""
    if not order:
        return np.full((len(ends), len(model.langs)), model.unseen, np.float32)
    start = ends - (order - 1)
    h = codes[start].copy()
    for i in range(1, order):
        h *= _R
        h += codes[start + i]
    keys, values = model.grams[order - 1]
    at, there = _find(keys, h)
    out = values[at] if len(keys) else np.zeros((len(ends), len(model.langs)), np.float32)
    if not there.all():
        miss = np.flatnonzero(~there)
        low = _log_p(model, codes, ends[miss], order - 1)
        if order > 1:
            start = start[miss]
            h = codes[start].copy()
            for i in range(1, order - 1):
                h *= _R
                h += codes[start + i]
        else:
            h = np.zeros(len(miss), np.uint64)
        keys, weights = model.contexts[order - 1]
        at, known = _find(keys, h)
        if known.any():
            low[known] += weights[at[known]]
        out[miss] = low
    return out


class Judge:
    """A worker's copy of a model, with the sums of the runs it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.sums = np.empty((1024, len(model.langs) + 2), np.float32)

    def learn(self, new: list[str]) -> None:
        """Sums of log2 probabilities (a column for each language, then the background's) and lengths of runs."""
        model, n = self.model, len(self.known)
        while len(self.sums) < n + len(new):
            self.sums = np.concatenate([self.sums, np.empty_like(self.sums)])
        keys, values = model.background
        streams = [stream(r) for r in new]
        sizes = np.array([len(x) for x in streams])
        out = self.sums[n : n + len(new)]
        out[:] = 0
        at = 0
        while at < len(new):
            stop, held = at + 1, sizes[at]
            while stop < len(new) and held + sizes[stop] <= _CHUNK:
                held += sizes[stop]
                stop += 1
            codes = _codes("".join(streams[at:stop]))
            owner = np.repeat(np.arange(at, stop), sizes[at:stop])
            ends = np.flatnonzero(np.arange(len(codes)) - (np.cumsum(sizes[at:stop]) - sizes[at:stop])[owner - at] >= ORDER - 1)
            if len(ends):
                owner = owner[ends]
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                who = owner[cuts]
                out[who, :-2] = np.add.reduceat(_log_p(model, codes, ends, ORDER), cuts, axis=0)
                place, there = _find(keys, codes[ends])
                out[who, -2] = np.add.reduceat(np.where(there, values[place], np.float32(model.unseen)), cuts)
                out[who, -1] = np.diff(cuts, append=len(ends))
            at = stop
        self.known.update(zip(new, range(n, n + len(new))))

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy, margin and rejection of each text."""
        n, model = len(texts), self.model
        langs, scores, entropy, margin = [NONE] * n, np.zeros(n), np.full(n, np.nan), np.full(n, -np.inf)
        if not model.langs or not n:
            return langs, scores, entropy, margin, np.ones(n, bool)
        sums = np.zeros((n, len(model.langs) + 2))
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def add() -> None:
            if len(self.known) + len(held) > CACHE + _CHUNK:
                self.known.clear()
            new = set(held).difference(self.known)
            if new:
                self.learn(list(new))
            ids = np.fromiter(map(self.known.__getitem__, held), np.int64, len(held))
            rows, cuts = zip(*owners)
            np.add.at(sums, np.array(rows), np.add.reduceat(self.sums[ids], np.array(cuts), axis=0, dtype=np.float64))
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            runs = runs_of(text)
            for a in range(0, len(runs), _CHUNK):
                owners.append((i, len(held)))
                held += runs[a : a + _CHUNK]
                if len(held) > _CHUNK // 4:
                    add()
        if held:
            add()
        lengths = sums[:, -1]
        rows = np.flatnonzero(lengths > 0)
        if len(rows):
            h = -sums[rows, :-2] / lengths[rows, None]
            best = h.argmin(1)
            low = h[np.arange(len(rows)), best]
            entropy[rows] = low
            margin[rows] = -sums[rows, -2] / lengths[rows] - low
            scores[rows] = 1 / np.exp2(np.maximum(-1000, (low[:, None] - h) * SHARPNESS)).sum(1)
            for r, b in zip(rows, best):
                langs[r] = model.langs[b]
        return langs, scores, entropy, margin, ~(margin >= model.threshold)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch.column("text"))):
                c = found.setdefault(lang, Counter())
                for run, n in Counter(runs_of(text)).items():
                    s = stream(run)
                    for i in range(len(s) - ORDER + 1):
                        c[s[i : i + ORDER]] += n
            rows = [(k, g, n) for k, c in found.items() for g, n in c.items()]
            lang, gram, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    """Models from the rows where learn holds and lang is not null."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)).alias("h"))
    sizes = rows.groupBy("lang").count().withColumn("under", F.least(F.lit(1 << 30), F.floor(max_docs * (1 << 30) / F.col("count"))))
    # Two values a language, of which the broadcast model holds all n-grams: no text is shuffled.
    sample = rows.join(F.broadcast(sizes.select("lang", "under")), "lang").filter("h < under").drop("under")
    held = F.pmod(F.shiftright("h", 3), F.lit(CALIBRATE)) == 0
    counts: dict[str, Counter] = {}
    for r in _counts(sample.filter(~held)).toPandas().itertuples():
        counts.setdefault(r.lang, Counter())[r.gram] = r.n
    if not counts:
        return Model([], [], [], 0.0, (np.empty(0, np.uint64), np.empty(0, np.float32)), 0.0)
    model = fit(counts)
    margins = np.array([r["margin"] for r in predict(sample.filter(held), model, margins=True).filter(F.col("lang_pred") != NONE).select("margin").collect()])
    if len(margins):
        model = model._replace(threshold=min(0.0, float(np.quantile(margins, QUANTILE, method="lower"))))
    return model


RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


def predict(docs: DataFrame, model: Model, text_col: str = "text", margins: bool = False) -> DataFrame:
    """docs with lang_pred, score, cross_entropy (bits a character, null if `und`) and rejected; margins: also margin.

    Columns of docs with these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in batches:
            column = batch.column(text_col)
            parts = [judge.texts(strings(column.slice(i, _ROWS))) for i in range(0, max(1, len(column)), _ROWS)]
            langs = [x for part in parts for x in part[0]]
            scores, entropy, margin, out = (np.concatenate(x) for x in list(zip(*parts))[1:])
            new = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores), "cross_entropy": pa.array(entropy, from_pandas=True), "rejected": pa.array(out)}
            yield with_arrays(batch, new | ({"margin": pa.array(margin)} if margins else {}))

    return docs.mapInArrow(run, with_schema(docs, RESULT + ", margin double" * margins))
