import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helixflow.llm import lexical, pstable

# ---------------------------------------------------------------- nearest neighbours

VECTORS = "vec_id bigint, embedding array<float>, id string, vec string, spot string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], VECTORS)


def nearest(rows, queries, k):
    """Brute force: {query id: [(id, score)]}."""
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and good(v)]
    out = {}
    for i, q in [(i, np.array(v, np.float32).astype(float)) for i, v in queries if i is not None and good(v)]:
        some = sorted(((-float((q * x).cumsum()[-1]), j) for j, x in rows if j != i and len(x) == len(q)))
        out[i] = [(j, -s) for s, j in some[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def cloud():
    """Clusters, a third of all rows near one point, copies of one vector, lengths that differ."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    x = centres[rng.integers(20, size=2400)] + 0.5 * rng.standard_normal((2400, 24))
    x[:800] = centres[0] + 0.01 * rng.standard_normal((800, 24))
    x[800:1000] = x[1000]
    x[2300:] *= 3
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("bounds", [{}, {"ROWS": 64, "QUERIES": 16, "BUCKET_ROWS": 60}])
def test_recall_and_exact_scores(spark, cloud, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(pstable, name, value)
    rows = vector_frame(spark, cloud)
    got = found(pstable.top_k(rows, rows.filter("vec_id % 20 = 0"), 20))
    want = nearest(cloud, cloud[::20], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    # of equal scores any may be met, so places are compared by score
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {i: np.array(v, np.float32).astype(float) for i, v in cloud}
    for q, near in got.items():
        assert all(s == (exact[q] * exact[j]).cumsum()[-1] for j, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_ties_and_rows_that_take_no_part(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0]), (62, [1.0, None]), (63, [float("nan"), 1.0]), (64, [float("inf"), 1.0]), (65, []), (None, [1.0, 1.0]), (66, [1.0, 2.0, 3.0]), (67, [-1.0, 0.0])]
    df = vector_frame(spark, rows)
    got = found(pstable.top_k(df, df.filter("vec_id in (0, 3, 59, 60, 61, 63, 67) or vec_id is null"), 20))
    assert sorted(got) == [0, 3, 59, 67]
    assert [j for j, _ in got[0]] == list(range(1, 21)) and [j for j, _ in got[3]] == [0, 1, 2, *range(4, 21)] and [j for j, _ in got[67]] == list(range(20))
    few = vector_frame(spark, rows[:4])
    assert {q: [j for j, _ in v] for q, v in found(pstable.top_k(few, few, 20)).items()} == {0: [1, 2, 3], 1: [0, 2, 3], 2: [0, 1, 3], 3: [0, 1, 2]}
    assert pstable.top_k(df.limit(0), df, 5).count() == 0 and pstable.top_k(df, df.limit(0), 5).count() == 0


def test_short_answers_are_searched_again(spark, cloud, monkeypatch):
    monkeypatch.setattr(pstable, "BUCKET_ROWS", 4)
    fit = pstable.fit

    def stingy(*args):
        hashes = fit(*args)
        hashes.functions, hashes.total = 8, 1e-9  # one bucket a table
        return hashes

    monkeypatch.setattr(pstable, "fit", stingy)
    rows = vector_frame(spark, cloud)
    got = found(pstable.top_k(rows, rows.filter("vec_id % 100 = 0"), 20))
    assert len(got) == 24 and all(len(v) == 20 for v in got.values())


def test_probes_come_in_the_order_of_success():
    h = pstable.Hashes(6, 1.0, 0.5, 5)
    q = np.random.default_rng(1).standard_normal((8, 6))
    for t in range(h.tables):
        spots, before = h.probes(t, q)
        assert (np.diff(before, axis=1) >= 0).all() and (np.diff(np.diff(before, axis=1), axis=1) <= 1e-9).all()
        assert before[:, -1].max() <= 1.001
        x = q / np.sqrt((q**2).sum(1))[:, None]
        assert ((spots == h.spots(t, x)[:, None]).sum(1) == 1).all()


# ---------------------------------------------------------------- ranked lexical search


def terms(text):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, want in asked.items():
        scores = []
        for doc, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in want.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "x9", "été"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n)).replace("w1 ", "W1, ").replace("w2 ", "w2_\n")
    docs = [(i, text(rng.randint(1, 60))) for i in range(300)]
    docs += [(500 + i, docs[7][1]) for i in range(30)]  # ties
    docs += [(600, None), (601, ""), (602, " ,;\n"), (603, text(30000)), (None, docs[7][1]), (7, docs[9][1])]
    items = [(i, text(rng.randint(1, 15))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, docs[7][1]), (None, "w3 w5"), (4, "w40 w41")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, item_id string, score int")
    return d, spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, rank string")


@pytest.mark.parametrize("bounds", [{}, {"shard_docs": 40}, {"shard_docs": 40, "item_bytes": 60}])
def test_lexical_search_against_brute_force(spark, texts, bounds):
    docs, items = texts
    got = [tuple(r) for r in lexical.top_k(*frames(spark, docs, items), 20, **bounds).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])) == ranked(docs, items, 20)


def test_non_essential_lists_are_probed_for_few(texts):
    """MaxScore reads fewer postings than there are, and gives the same answer shard by shard."""
    rng = np.random.default_rng(2)
    n, k = 4000, 5
    sizes = rng.integers(20, 60, n)
    places, tfs, df = [], [], []
    for share in (0.9, 0.8, 0.7, 0.01, 0.005):
        at = np.flatnonzero(rng.random(n) < share).astype(np.int32)
        places.append(at), tfs.append(rng.integers(1, 4, len(at)).astype(np.int32)), df.append(len(at))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in enumerate(df)}
    search = lexical.Searcher([{t: 1 for t in range(5)}], weight, n, int(sizes.sum()), k)
    search.shard(list(range(n)), sizes, np.arange(5), np.array(df), np.concatenate(places), np.concatenate(tfs))
    m = 75 + (25 * sizes * n) // int(sizes.sum())
    score = np.zeros(n, np.int64)
    for t in range(5):
        tf = tfs[t].astype(np.int64)
        score[places[t]] += weight[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[places[t]]))
    best = sorted(((-s, i) for i, s in enumerate(score.tolist())))[:k]
    assert search.best[0] == [(-s, i) for s, i in best]
    assert search.postings + search.probed < sum(df) / 4


def test_lexical_search_of_empty_tables(spark, texts):
    docs, items = frames(spark, *texts)
    assert lexical.top_k(docs.limit(0), items).count() == 0
    assert lexical.top_k(docs, items.limit(0)).count() == 0
    assert lexical.top_k(docs.filter("doc_id in (600, 601, 602)"), items).count() == 0

