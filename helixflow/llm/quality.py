"""Quality classifier: document evidence combined with hierarchical empirical Bayes over hosts and paths.

Evidence: a lexicon of words whose presence in training documents goes with a target (toxic, or of low quality) is
learned by grouped counts; a document's features are its lexicon words and its style (upper case, symbols, digits,
repeated lines and words, lengths). A logistic model over them gives the evidence as log odds against the base rate.
Lexicon and model are fitted on about SAMPLE labelled documents, picked by a hash of the key (all, where there are
fewer), the model on SAMPLE rows of them at most, by a hash of key and features; texts of other documents are never shuffled. Hosts and paths use all training labels.

Prior: a Beta prior's mean and strength for hosts come from the moments of all hosts' label counts, and those of
paths from the paths within their hosts. A path's posterior shrinks to its host's, a host's to the global rate, the
more the fewer labels it has; hosts and paths without labels get their parent's. The final log odds are the evidence
plus the log odds of the path's posterior.

A document of several sites (pages) counts once at each of its paths and once at each of its hosts, and its prior is
the mean of its paths' posteriors; repeated rows of a document count once there.

Defined results: null texts are empty texts, and whole texts are read, of any length; a null host or path is a value of
its own; null labels are left out; repeated labels of one document count once (the highest toxic, the lowest quality);
lexicon words that tie are taken in order; a target without labels of both kinds has evidence 0, without labels the
prior is 0 and everything is kept; empty documents give no rows. Only the named columns are read, so others may have
any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_arrays, with_schema

TARGETS = ("toxic", "low")
LEXICON = 2000
#: Least standard deviations of a lexicon word's log odds from 0, and documents that it is in.
LEAST_Z = 4.0
LEAST_DOCS = 5
SAMPLE = 20_000
_RUNS = re.compile(r"[^\W\d_]+")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FLUSH = 1 << 18


def lexicon_counts(docs: DataFrame) -> DataFrame:
    """(word, n, toxic, low): how many rows of (text, toxic, low) hold a word, and of each target."""

    def flush(found: Counter, hits: dict[str, Counter]) -> pa.RecordBatch:
        ws = list(found)
        cols = [pa.array(ws, pa.string()), pa.array([found[w] for w in ws], pa.int64()), *(pa.array([hits[t][w] for w in ws], pa.int64()) for t in TARGETS)]
        return pa.RecordBatch.from_arrays(cols, names=["word", "n", *TARGETS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, hits = Counter(), {t: Counter() for t in TARGETS}
        for batch in batches:
            flags = [batch.column(t).to_pylist() for t in TARGETS]
            for i, text in enumerate(batch.column("text").to_pylist()):
                ws = set(_RUNS.findall((text or "").lower()))
                found.update(ws)
                for t, flag in zip(TARGETS, flags):
                    if flag[i]:
                        hits[t].update(ws)
                if len(found) > _FLUSH:
                    yield flush(found, hits)
                    found, hits = Counter(), {t: Counter() for t in TARGETS}
        yield flush(found, hits)

    counted = docs.mapInArrow(run, "word string, n bigint, toxic bigint, low bigint")
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS)))


def lexicon(counts: DataFrame, rows: int, positive: dict[str, int]) -> dict[str, dict[str, float]]:
    """For each target, the log odds of the LEXICON words that go with it most surely."""
    out = {}
    for t in TARGETS:
        a, b = F.col(t) + 0.5, F.col("n") - F.col(t) + 0.5
        c, d = positive[t] - F.col(t) + 0.5, rows - positive[t] - (F.col("n") - F.col(t)) + 0.5
        odds = F.log(a * d / (b * c))
        z = odds / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        best = counts.filter(F.col("n") >= LEAST_DOCS).select("word", odds.alias("odds"), z.alias("z")).filter(F.abs("z") >= LEAST_Z)
        out[t] = {r["word"]: r["odds"] for r in best.orderBy(F.abs("z").desc(), "word").limit(LEXICON).collect()}
    return out


def style(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    letters = max(1, int(counts[_LETTER].sum()))
    ws, lines = raw.split(), [x for x in text.split("\n") if x]
    share = lambda mask: float(counts[mask].sum()) / n
    symbols = 1 - share(_LETTER) - share(_DIGIT) - share(_SPACE)
    return [float(counts[_UPPER].sum()) / letters, symbols, share(_DIGIT), 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(ws)) / max(1, len(ws)), np.log1p(len(ws)), len(raw) / max(1, len(ws)) / 10, float(len(ws) < 20)]


FEATURES = 8 + 3 * len(TARGETS)


def features(docs: DataFrame, words: dict[str, dict[str, float]], text_col: str = "text") -> DataFrame:
    """docs without text_col, with x: the features of each row."""
    held = docs.sparkSession.sparkContext.broadcast(words)
    out = docs.drop(text_col)
    names = list(out.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = set().union(*held.value.values())
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                text = text or ""
                found = every.intersection(_RUNS.findall(text.lower()))
                x = style(text)
                for t in TARGETS:
                    odds = [held.value[t][w] for w in found if w in held.value[t]]
                    up = [o for o in odds if o > 0]
                    x += [max(up, default=0.0), min(sum(up), 30.0) / 10, float(len(up) > 0)]
                rows.append(x)
            kept = pa.RecordBatch.from_arrays([batch.column(n) for n in names], names=names)
            yield with_arrays(kept, {"x": pa.array(rows, pa.list_(pa.float64()))})

    return docs.mapInArrow(run, with_schema(out, "x array<double>"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant last) of a ridge logistic regression by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _dot(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    mean, scale, w = model
    z = F.lit(float(w[-1]))
    for i in range(len(mean)):
        z = z + (F.col("x")[i] - float(mean[i])) / float(scale[i]) * float(w[i])
    return z


def posterior(groups: DataFrame, target: str, mean: Column, strength: float) -> Column:
    """Posterior rate of a group with n labels, `target` of them positive."""
    return (F.col(target) + mean * strength) / (F.col("n") + strength)


def strength(groups: DataFrame, target: str, mean: float) -> float:
    """Prior strength (in labels) of a Beta-binomial by moments over groups of (n, target)."""
    g = groups.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count(F.lit(1)), F.sum(F.col("n") * F.pow(F.col(target) / F.col("n") - mean, 2))).first()
    n, squares, k, spread = (float(v or 0) for v in g)
    if k < 2 or mean <= 0 or mean >= 1:
        return 100.0
    within = mean * (1 - mean)
    between = (spread - (k - 1) * within) / max(n - squares / n, 1e-9)
    return float(np.clip(within / max(between, 1e-9) - 1, 1.0, 10_000.0))


def judged(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", host_col: str = "host", path_col: str = "path", sites: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_toxic, p_low (posterior probabilities), evidence of both, and kept (neither reaches threshold).

    labels: (doc_id, quality, toxic). training: over labels' doc_id, the labels to learn from. sites: (doc_id, host,
    path), any number of rows a document, for documents whose host is not host_col; joined to features, not to texts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & training).groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    known = known.filter("t is not null and q is not null").select(F.col("doc_id").alias("__id"), (F.col("t") == 1).cast("long").alias("toxic"), (F.col("q") == 0).cast("long").alias("low"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("low"), F.lit(0))).first()
    rate = min(1.0, SAMPLE / max(1, total[0]))
    picked = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) < int(rate * (1 << 30))
    words = {t: {} for t in TARGETS}
    if total[0]:
        learn = docs.select("doc_id", "text").filter(picked("doc_id")).join(known.filter(picked("__id")), F.col("doc_id") == F.col("__id")).select("text", *TARGETS)
        learn = materialize(learn, "learn")
        n = learn.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(t), F.lit(0)) for t in TARGETS)).first()
        words = lexicon(materialize(lexicon_counts(learn), "lexicon"), n[0], dict(zip(TARGETS, n[1:])))
    x = materialize(features(docs, words), "features")
    known = materialize(known, "known")
    seats = x.select("doc_id", "host", "path")
    if sites is not None:
        sites = materialize(sites.filter("doc_id is not null").select("doc_id", "host", "path").distinct(), "sites")
        seats = seats.join(sites.select("doc_id"), "doc_id", "left_anti").union(sites.join(x.select("doc_id"), "doc_id", "left_semi"))
    marked = materialize(seats.join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "host", "path", *TARGETS).distinct(), "marked")
    labelled = x.filter(picked("doc_id")).join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "x", *TARGETS)
    some = labelled.orderBy(F.xxhash64("doc_id", "x"), "doc_id").limit(SAMPLE).collect()
    hosts = materialize(_counted(marked.select("doc_id", "host", *TARGETS).distinct(), "host"), "hosts")
    paths = materialize(_counted(marked, "host", "path"), "paths")
    means = {t: _mean(hosts, t) for t in TARGETS}
    h = hosts.select(F.col("host").alias("__h"), *(_rate(hosts, t).alias(f"h_{t}") for t in TARGETS))
    p = paths.join(h, F.col("host").eqNullSafe(F.col("__h"))).drop("__h")
    p = p.select(F.col("host").alias("__h"), F.col("path").alias("__p"), *(posterior(p, t, F.col(f"h_{t}"), strength(paths, t, _mean(paths, t))).alias(f"p_{t}") for t in TARGETS))

    def placed(rows: DataFrame) -> DataFrame:
        """rows of (host, path, ...) with the priors of their sites."""
        out = rows.join(h, F.col("host").eqNullSafe(F.col("__h")), "left").drop("__h")
        out = out.join(p, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")), "left")
        priors = (F.coalesce(f"p_{t}", f"h_{t}", F.lit(means[t])).alias(f"prior_{t}") for t in TARGETS)
        return out.select(*rows.columns, *priors)

    out = placed(x)
    if sites is not None:
        own = placed(sites).groupBy(F.col("doc_id").alias("__site")).agg(*(F.avg(f"prior_{t}").alias(f"own_{t}") for t in TARGETS))
        out = out.join(own, F.col("doc_id") == F.col("__site"), "left").select("doc_id", "x", *(F.coalesce(f"own_{t}", f"prior_{t}").alias(f"prior_{t}") for t in TARGETS))
    cols = []
    for t in TARGETS:
        y = np.array([r[t] for r in some], float)
        if not len(y) or not 0 < y.mean() < 1:
            evidence = F.lit(0.0)
        else:
            evidence = _dot(logistic(np.array([r["x"] for r in some]), y)) - float(np.log(y.mean() / (1 - y.mean())))
        prior = F.least(F.greatest(f"prior_{t}", F.lit(1e-6)), F.lit(1 - 1e-6))
        odds = evidence + F.log(prior / (1 - prior))
        cols += [(1 / (1 + F.exp(-odds))).alias(f"p_{t}"), evidence.alias(f"evidence_{t}")]
    out = out.select("doc_id", *cols)
    return out.withColumn("kept", (F.col("p_toxic") < threshold) & (F.col("p_low") < threshold))


def _counted(marked: DataFrame, *by: str) -> DataFrame:
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(t) for t in TARGETS))


def _mean(groups: DataFrame, target: str) -> float:
    n, hit = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(target), F.lit(0))).first()
    return hit / n if n else 0.0


def _rate(hosts: DataFrame, target: str) -> Column:
    mean = _mean(hosts, target)
    return posterior(hosts, target, F.lit(mean), strength(hosts, target, mean))
