import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixflow.operators import aggregates, jackknife, knn, models, ordinals
from helixflow.operators.segments import viterbi


def panel(spark, n=2000, blocks=20, seed=0, **extra):
    rng = np.random.default_rng(seed)
    cols = {k: rng.random(n) for k in "abcd"} | extra
    rows = [(i, i * blocks // n, *(float(cols[k][i]) for k in cols)) for i in range(n)]
    return spark.createDataFrame(rows, "site bigint, blk bigint, " + ", ".join(f"{k} double" for k in cols)), cols


def numpy_jackknife(num, den, block):
    theta = num.sum() / den.sum()
    loo = np.array([(num.sum() - num[block == b].sum()) / (den.sum() - den[block == b].sum()) for b in np.unique(block)])
    return theta, np.sqrt((len(loo) - 1) * loo.var())


def test_jackknife_against_numpy(spark):
    df, c = panel(spark)
    r = jackknife.jackknife(df, [jackknife.dstat("d", *(F.col(k) for k in "abcd"))], []).first()
    num = (c["a"] - c["b"]) * (c["c"] - c["d"])
    den = (c["a"] + c["b"] - 2 * c["a"] * c["b"]) * (c["c"] + c["d"] - 2 * c["c"] * c["d"])
    theta, se = numpy_jackknife(num, den, np.arange(2000) * 20 // 2000)
    assert r["theta_d"] == pytest.approx(theta, rel=1e-9)
    assert r["se_d"] == pytest.approx(se, rel=1e-9)
    assert r["blocks_d"] == 20 and r["sites_d"] == 2000


def test_f4_identities(spark):
    df, _ = panel(spark)
    a, b, c, d = (F.col(k) for k in "abcd")
    r = df.agg(F.max(F.abs(jackknife.f4(a, b, c, d) + jackknife.f4(b, a, c, d))).alias("x"), F.max(F.abs(jackknife.f4(a, b, c, c))).alias("y")).first()
    assert r["x"] < 1e-12 and r["y"] == 0


def test_f4_ratio_ends(spark):
    df, _ = panel(spark)
    one = jackknife.f4_ratio("one", F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("c"))
    zero = jackknife.f4_ratio("zero", F.col("a"), F.col("b"), F.col("d"), F.col("d"), F.col("c"))
    r = jackknife.jackknife(df, [one, zero], []).first()
    assert r["theta_one"] == pytest.approx(1) and r["theta_zero"] == pytest.approx(0)


def test_one_block_and_missing_values(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, None, 1.0), (0, 3.0, None)], "blk bigint, n double, d double")
    r = jackknife.jackknife(df, [jackknife.Statistic("s", F.col("n"), F.col("d"))], []).first()
    assert r["theta_s"] == 0.5 and r["se_s"] is None and r["z_s"] is None and r["sites_s"] == 1
    empty = jackknife.jackknife(df.filter("n > 9"), [jackknife.Statistic("s", F.col("n"), F.col("d"))], []).first()
    assert empty["theta_s"] is None


def test_blocks_are_equal(spark):
    rows = jackknife.assign_blocks(spark.range(1000).withColumnRenamed("id", "site"), "site", 10).groupBy("blk").count().collect()
    assert sorted((r["blk"], r["count"]) for r in rows) == [(i, 100) for i in range(10)]


def test_spearman_with_ties(spark):
    x, y = [1, 2, 2, 3, 5, 5, 5, 8], [2, 1, 3, 3, 4, 9, 9, 9]
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double")

    def rank(v):
        v = np.array(v, float)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert aggregates.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_tails():
    assert models.normal_isf(0.025) == pytest.approx(1.959964, abs=1e-5)
    assert models.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert models.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert models.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=5e-3)


def test_ols_against_lstsq(spark):
    rng = np.random.default_rng(0)
    x, e = rng.random((60, 2)), rng.normal(0, 0.1, 60)
    y = 1 + 2 * x[:, 0] - x[:, 1] + e
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    got = models.ols(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")})
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert [r[1] for r in got] == pytest.approx(want)


def test_pca_up_to_sign(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (200, 6))
    df = spark.createDataFrame([(s, i, int(g[s, i])) for s in range(200) for i in range(6)], "site int, ind int, g int")
    ids, rows = models.site_rows(df)
    scores, top, share = models.pca(rows, len(ids), 2)
    p = g.mean(1) / 2
    ok = (p > 0) & (p < 1)
    z = ((g - 2 * p[:, None]) / np.sqrt(2 * p * (1 - p))[:, None])[ok].T
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert ids == list(range(6))
    assert np.abs(scores) == pytest.approx(np.abs(u[:, :2] * s[:2]), rel=1e-6)
    assert top.sum() == pytest.approx(1)
    assert share == pytest.approx(s[:2] ** 2 / (s**2).sum())


def test_pca_of_many_individuals_with_missing_calls(spark):
    """Three populations of 40; a missing call counts as the site's mean."""
    rng = np.random.default_rng(4)
    p = np.clip(rng.uniform(0.1, 0.9, (600, 1)) + rng.normal(0, 0.15, (600, 3)), 0.02, 0.98)
    g = rng.binomial(2, np.repeat(p, 40, 1)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    df = spark.createDataFrame([(s, 1000 - i, None if np.isnan(g[s, i]) else int(g[s, i])) for s in range(600) for i in range(120)], "site int, ind int, g int")
    ids, rows = models.site_rows(df)
    assert ids == sorted(1000 - i for i in range(120))
    scores, _, share = models.pca(rows, len(ids), 2)
    f = np.nanmean(g, 1) / 2
    z = np.nan_to_num((g - 2 * f[:, None]) / np.sqrt(2 * f * (1 - f))[:, None]).T[::-1]
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = np.abs(u[:, :2] * s[:2])
    assert np.abs(np.abs(scores) - want).max() < 1e-3 * want.max()
    assert share == pytest.approx(s[:2] ** 2 / (s**2).sum(), rel=1e-5)
    # further power steps come as near as asked for
    scores, _, _ = models.pca(rows, len(ids), 2, power=14)
    assert np.abs(scores) == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_kinship_tiles_against_plain_pairs(spark):
    from helixflow.operators import kinship

    rng = np.random.default_rng(8)
    a = rng.integers(0, 2, (300, 23)).astype(float)
    a[rng.random(a.shape) < 0.4] = np.nan
    a[:, 5] = np.nan
    a[:, 6], a[:, 7] = np.nan, np.nan
    a[:2, 6], a[2:4, 7] = 1, 0  # no site in common
    df = spark.createDataFrame([(7 * s - 900, i * 3, None if np.isnan(a[s, i]) else int(a[s, i])) for s in range(300) for i in range(23)], "site bigint, ind bigint, a int")
    want = {}
    for i in range(23):
        for j in range(i + 1, 23):
            both = ~np.isnan(a[:, i]) & ~np.isnan(a[:, j])
            if both.sum():
                want[3 * i, 3 * j] = (float((a[both, i] != a[both, j]).mean()) if both.sum() >= 5 else None, int(both.sum()))
    for sizes in ({}, {"tile": 4, "words": 2}, {"tile": 23, "words": 1}):
        got = kinship.mismatch(df, 5, **sizes)
        assert {(r["i"], r["j"]): (r["p0"], r["n"]) for r in got.collect()} == want
    assert kinship.mismatch(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 7, 500])
def test_numbers_without_one_task(spark, rows):
    from helixflow.operators.ordinals import numbered

    df = spark.range(rows).select(((F.col("id") * 7919) % 1009).alias("k"), "id")
    got = [tuple(r) for r in numbered(df, [F.col("k").desc(), "id"]).orderBy("i").select("i", "k", "id").collect()]
    want = sorted(((i * 7919) % 1009, i) for i in range(rows))
    assert got == [(n, k, i) for n, (k, i) in enumerate(sorted(want, key=lambda x: (-x[0], x[1])))]
    plan = numbered(df, ["k", "id"])._jdf.queryExecution().toString()
    assert "Window" not in plan
    folds = [r[0] for r in models.folds(df, ["id"], 5).orderBy("id").select("fold").collect()]
    assert folds == [f for f, part in enumerate(np.array_split(np.arange(rows), 5)) for _ in part]


def brute_viterbi(carry, cm):
    from itertools import product

    e = np.array([[1 - 0.085, 0.085], [0.5, 0.5]])
    best, path = -np.inf, None
    for states in product((0, 1), repeat=len(carry)):
        p = np.log([0.92, 0.08][states[0]]) + np.log(e[states[0], carry[0]])
        for i in range(1, len(carry)):
            stay = np.exp(-(cm[i] - cm[i - 1]) / 25.0)
            to = (1 - stay) * [0.92, 0.08][states[i]] + stay * (states[i] == states[i - 1])
            p += np.log(max(to, 1e-12)) + np.log(e[states[i], carry[i]])
        if p > best + 1e-12:
            best, path = p, states
    return list(path)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(10):
        carry, cm = rng.integers(0, 2, 8), np.sort(rng.random(8) * 60)
        assert viterbi(carry, cm).tolist() == brute_viterbi(carry, cm)


def test_mixture_recovers_weights():
    rng = np.random.default_rng(0)
    w, blocks = 0.3, []
    for _ in range(30):
        a = rng.normal(1, 0.3, (3, 1)) * 200
        blocks.append((200, a[:, 0] * w + rng.normal(0, 0.5, 3), a))
    m = models.mixture(blocks)
    assert m["weights"][1] == pytest.approx(w, abs=0.01) and m["dof"] == 2 and 0 <= m["p"] <= 1


def test_nearest_of_many_equal_references(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    same = rng.choice(3000, 500, replace=False)
    x[same] = x[same[0]]
    order = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "id bigint, x array<double>")
    probe = sorted(same.tolist())[-1]
    for block, cell in ((1 << 16, 1 << 12), (1000, 300), (100, 3000)):
        got = knn.nearest(df.filter(f"id in ({probe}, {int(same[0])})"), df, 10, block, cell).orderBy("id", "rank").collect()
        assert {r["id"] for r in got} == {probe, int(same[0])}
        for i in (probe, int(same[0])):
            assert [r["neighbor"] for r in got if r["id"] == i] == sorted(same.tolist())[:10]


@pytest.mark.parametrize("block,cell,visits", [(1 << 16, 1 << 12, 1 << 16), (64, 40, 30), (1 << 16, 20, 100), (50, 10000, 1 << 16)])
def test_nearest_against_brute_force(spark, block, cell, visits):
    """Clusters far from the origin, a third of the rows equal, lattice points that tie; few and many pivots, cut cells."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(150, 3)) + rng.choice([0, 40, 1e4], (150, 1)), np.full((150, 3), 7.0), rng.integers(0, 4, (150, 3)).astype(float)])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "id bigint, x array<double>")
    ref = df.filter("id % 3 <> 0")
    ids = [i for i in range(len(x)) if i % 3]
    for k in (1, 7, 400):
        got = {}
        for r in knn.nearest(df, ref, k, block, cell, visits).collect():
            got.setdefault(r["id"], {})[r["rank"]] = (r["neighbor"], r["d2"])
        assert set(got) == set(range(len(x)))
        for i, near in got.items():
            d2 = ((x[i] - x[ids]) ** 2).sum(1)
            want = sorted(zip(d2.tolist(), ids))[:k]
            assert [near[r + 1] for r in range(len(near))] == [(j, d) for d, j in want]


def test_nearest_leaves_far_pieces_out(spark):
    """Queries in one of eight far clusters visit no piece of the others; no vector passes through the driver but pivots."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(800, 4)) + np.repeat(np.arange(8) * 1000.0, 100)[:, None]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(800)], "id bigint, x array<double>")
    indexed, pieces = knn._indexed(df, x[::50], 1 << 16)
    plan = knn._planned(df, pieces, 5).withColumn("bar", F.lit(100.0)).select("id", "x", "bar", "pieces")
    rest = knn._planned(plan, pieces, 5).collect()
    assert indexed.count() == 800 and len(pieces.cell) == 16
    assert max(len(r["pieces"]) for r in rest) == 1
    assert all(pieces.cell[p] // 2 == r["id"] // 100 for r in rest for p in r["pieces"])
    assert knn.nearest(df, df.limit(0), 3).count() == 0 and knn.nearest(df.limit(0), df, 3).count() == 0


def test_centred_leaves_small_groups(spark):
    rows = [(i, "a" if i < 40 else "b" if i < 50 else None, float(i % 7), 0.1) for i in range(60)]
    got = {r["id"]: r["v"] for r in knn.centred(spark.createDataFrame(rows, "id int, t string, v double, se double"), "v", "se", "t").collect()}
    off = np.mean([i % 7 for i in range(40)]) - np.mean([i % 7 for i in range(60)])
    assert all(got[i] == pytest.approx(i % 7 - (off if i < 40 else 0)) for i in range(60))


def test_nmf_components_reads_all_chromosomes(spark, tmp_path):
    from helixflow.plans.registry import queries

    src = "/root/testdata/sf0.001"
    for t in ("supplier", "nation", "lineitem"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    # no site on the first four chromosomes
    spark.read.parquet(f"{src}/part.parquet").withColumn("p_size", F.col("p_size") + 4).write.parquet(f"{tmp_path}/part.parquet")
    got = queries()["nmf_components"](spark, str(tmp_path)).collect()
    assert len(got) == 4 * len({r["nat"] for r in got}) > 0


def test_nmf_sites_fits_as_well_as_on_the_driver(spark):
    rng = np.random.default_rng(6)
    x = rng.dirichlet([0.3] * 3, 8) @ rng.random((3, 200))
    rows = [(j, i, float(x[i, j])) for i in range(8) for j in range(200)]
    w = np.array([r[1] for r in models.nmf_sites(spark.createDataFrame(rows, "site int, nat int, p double"), "nat", 3)])
    assert w.sum(1) == pytest.approx(np.ones(8)) and (w >= 0).all()
    # rows are shares, so x is w times non-negative components up to a scale of each row
    left = x - w @ np.linalg.lstsq(w, x, rcond=None)[0]
    assert np.linalg.norm(left) < 0.1 * np.linalg.norm(x - x.mean(0))


def test_within_z_against_numpy(spark):
    rng = np.random.default_rng(1)
    v, e, by = rng.normal(0.02, 0.01, 60), rng.uniform(0.001, 0.01, 60), ["a", "b", None]
    rows = [(i, by[i % 3], float(v[i]), float(e[i])) for i in range(60)]
    got = {r["id"]: r["z"] for r in aggregates.within_z(spark.createDataFrame(rows, "id int, t string, v double, e double"), "v", "e", "t", "z").collect()}
    for g in (0, 1):
        x, s, w = v[g::3], e[g::3], 1 / e[g::3] ** 2
        mu = np.average(x, weights=w)
        bio = max(0, np.average((x - mu) ** 2, weights=w) - np.average(s**2, weights=w))
        assert [got[i] for i in range(g, 60, 3)] == pytest.approx((x - mu) / np.sqrt(s**2 + bio))
    assert len(got) == 60 and all(got[i] is None for i in range(2, 60, 3))


def test_nmf_individuals_recovers_planted_shares(spark):
    """As good a fit as on the driver, planted shares up to the order of components, the same twice; missing calls, fixed sites."""
    rng = np.random.default_rng(3)
    n, sites, k = 45, 900, 3
    q = np.concatenate([np.eye(k)[np.arange(24) % k], rng.dirichlet(np.ones(k), n - 24)])
    g = rng.binomial(2, q @ rng.beta(0.2, 0.2, (k, sites))).astype(float)
    g[rng.random(g.shape) < 0.05] = np.nan
    g[:, 0], g[:, 1], g[:, 2] = 1, 0, np.nan
    rows = [(j, i, None if np.isnan(g[i, j]) else int(g[i, j])) for i in range(n) for j in range(sites)]
    df = spark.createDataFrame(rows, "site int, ind int, g int")
    got, again = models.nmf_individuals(df, k), models.nmf_individuals(df, k)
    assert [i for i, _ in got] == list(range(n))
    w = np.array([r for _, r in got])
    assert w.sum(1) == pytest.approx(np.ones(n)) and (w >= 0).all()
    assert w == pytest.approx(np.array([r for _, r in again]), abs=1e-6)
    c = np.corrcoef(w.T, q.T)[:k, k:]
    assert sorted(c.argmax(1)) == [0, 1, 2] and c.max(1).min() > 0.95
    x = np.where(np.isnan(g[:, 3:]), np.nanmean(g[:, 3:], 0), g[:, 3:])
    x = x[:, x.std(0) > 0]
    plain, _ = models.nmf(x, k)
    loss = lambda f: np.linalg.norm(x - f @ np.linalg.lstsq(f, x, rcond=None)[0])
    assert loss(w) < 1.05 * loss(plain)
    assert models.nmf_individuals(df.filter("site < 3"), k) == [] and models.nmf_individuals(df.limit(0), k) == []


def test_kinship_p0_all_counts_every_site(spark):
    from helixflow.plans.genetics import calls
    from helixflow.plans.registry import queries

    d = "/root/testdata/sf0.001"
    each = calls(spark, d).filter("g is not null").groupBy("site").count().collect()
    got = queries()["kinship_p0_all"](spark, d).agg(F.sum("n")).first()[0]
    assert got == sum(r["count"] * (r["count"] - 1) // 2 for r in each)


def test_chi2_tail_at_its_bounds():
    assert models.chi2_sf(-1e-9, 3) == models.chi2_sf(0.0, 3) == 1.0
    assert models.chi2_sf(1e-6, 3) > 0.99 and models.chi2_sf(1e4, 3) < 1e-6


@pytest.mark.parametrize("closed", [True, False])
def test_interval_join_against_all_pairs(spark, closed):
    """Overlapping, nested, one-point, bin-crossing and chromosome-wide intervals; NULLs and turned ones hold nothing."""
    from helixflow.operators import loci

    rng = np.random.default_rng(6)
    spans = [(i, int(rng.integers(3)), int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(-500, 5000, 120), rng.choice([0, 1, 7, 8, 63, 64, 65, 700, 9000], 120)))]
    spans += [(500, 1, -(10**9), 10**9), (501, 1, 10, 3), (502, None, 0, 100), (503, 1, None, 5), (504, 1, 8, None)]
    points = [(i, int(rng.integers(3)), int(p)) for i, p in enumerate(rng.integers(-600, 6000, 300))] + [(900, None, 5), (901, 1, None), (902, 1, 8), (903, 1, 8)]
    p = spark.createDataFrame(points, "point bigint, chrom int, pos bigint")
    s = spark.createDataFrame(spans, "span bigint, chrom int, lo bigint, hi bigint")
    want = sorted(
        (a, i) for a, c, x in points for i, k, lo, hi in spans
        if None not in (c, x, k, lo, hi) and c == k and lo <= x and (x <= hi if closed else x < hi)
    )
    for width in (8, 1 << 14):
        joined = loci.interval_join(p, s, ["chrom"], "pos", "lo", "hi", closed=closed, bin_width=width)
        assert sorted((r["point"], r["span"]) for r in joined.collect()) == want
        plan = joined._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert loci.interval_join(p, s.limit(0), ["chrom"], "pos", "lo", "hi").count() == 0


def test_pools_of_a_reference_are_bits(spark):
    """A reference's pools go with every list that it is in, so they take a bit each, not a number each."""
    rng = np.random.default_rng(3)
    for pools in (1, 8, 105):
        want = {i: np.flatnonzero(rng.random(pools) < 0.6).tolist() for i in range(20)} | {20: []}
        got = knn._packed(spark.createDataFrame(list(want.items()), "id bigint, pools array<int>"), pools).collect()
        assert {r["id"]: np.flatnonzero(np.unpackbits(np.frombuffer(r["pools"], np.uint8), count=pools)).tolist() for r in got} == want
        assert {len(r["pools"]) for r in got} == {-(-pools // 8)}


def test_pools_of_references_against_one_search_each(spark):
    """Small pools need further searches; each pool's z is that of its own references alone."""
    rng = np.random.default_rng(12)
    n, k = 150, 5
    x, value, se = rng.normal(size=(n, 3)), rng.normal(0.02, 0.01, n), rng.uniform(0.001, 0.01, n)
    member = rng.random((n, 4)) < np.array([1, 0.5, 0.08, 0.0])
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id bigint, x array<double>")
    samples = spark.createDataFrame([(i, float(value[i]), float(se[i])) for i in range(n)], "id bigint, value double, se double")
    members = spark.createDataFrame([(i, np.flatnonzero(member[i]).tolist()) for i in range(n)], "id bigint, pools array<int>")
    got = {(r["id"], r["pool"]): r["z"] for r in knn.pool_scores(vectors, vectors, samples, members, k, 4, ahead=2).collect()}
    assert len(got) == 4 * n
    for pool in range(4):
        own = [i for i in range(n) if member[i, pool]]
        for i in range(n):
            near = sorted(own, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[: k + 1]
            w = np.array([0.0 if j == i else 1 / max(se[j], 1e-4) ** 2 for j in near])
            if not w.sum():
                assert got[i, pool] is None
                continue
            mean = (w * value[near]).sum() / w.sum()
            var = (w * (value[near] - mean) ** 2).sum() / w.sum()
            bio = max(0, var - (w * se[near] ** 2).sum() / w.sum())
            assert got[i, pool] == pytest.approx((value[i] - mean) / np.sqrt(se[i] ** 2 + bio + var / k))


def test_bonferroni_threshold():
    assert aggregates.bonferroni_z(1) == pytest.approx(1.959964, abs=1e-6)
    assert aggregates.bonferroni_z(9252) == pytest.approx(4.55, abs=5e-3)


def test_gates(spark):
    from helixflow.operators.gates import Gate, gate_table, judged

    values = {"a": 1.0, "b": 2.0, "c": 2.0, "d": float("nan"), "e": None, "f": -5.0, "zero": 0.0}
    estimates = spark.createDataFrame([(m, "s", v) for m, v in values.items()] + [("a", "t", 9.0)], "member string, statistic string, value double")
    cases = [
        (Gate("all in", "s", ("a", "b"), low=1.0, high=2.0), 2, True),
        (Gate("strict", "s", ("a", "b"), low=1.0, high=2.0, strict=True), 0, False),
        (Gate("enough", "s", ("a", "b", "f"), low=0.0, needed=2), 2, True),
        (Gate("size", "s", ("f",), low=4.0, absolute=True), 1, True),
        (Gate("missing", "s", ("a", "d", "e", "none")), 1, False),
        (Gate("rising", "s", ("f", "a", "b"), ordered=True), 3, True),
        (Gate("tie", "s", ("a", "b", "c"), ordered=True), 2, False),
        (Gate("after a gap", "s", ("a", "d", "b"), ordered=True), 1, False),
        (Gate("margin", "s", ("a", "b"), ordered=True, margin=2.0), 1, False),
        (Gate("margin of zero", "s", ("zero", "a"), ordered=True, margin=2.0), 2, True),
        (Gate("other", "t", ("a", "b"), needed=1), 1, True),
    ]
    got = {r["gate"]: (r["met"], r["passed"]) for r in judged(estimates, gate_table(spark, [c[0] for c in cases])).collect()}
    assert got == {g.name: (met, passed) for g, met, passed in cases}


@pytest.mark.parametrize("weights", [(0.7, 0.3), (0.5, 0.3, 0.2), (0.4, 0.3, 0.2, 0.1)])
def test_mixtures_of_many_sources_against_plain_f4(spark, weights):
    """One pass of sums gives what f4 means over the same sites give, and the planted weights come back."""
    rng = np.random.default_rng(len(weights))
    n, s = 6000, len(weights)
    pops = ["t", *(f"s{k}" for k in range(s)), *(f"o{k}" for k in range(6))]
    base = rng.uniform(0.2, 0.8, n)
    out = {f"o{k}": np.clip(base + rng.normal(0, 0.15, n), 0, 1) for k in range(6)}
    src = {f"s{k}": np.clip(base + sum(c * (out[f"o{j}"] - base) for j, c in enumerate(rng.normal(0, 0.5, 6))) + rng.normal(0, 0.02, n), 0, 1) for k in range(s)}
    freq = out | src | {"t": sum(w * src[f"s{k}"] for k, w in enumerate(weights)) + rng.normal(0, 0.005, n)}
    gap = rng.random(n) < 0.02
    blk = np.arange(n) * 20 // n
    df = spark.createDataFrame([(int(blk[i]), *(None if p == "o1" and gap[i] else float(freq[p][i]) for p in pops)) for i in range(n)], "blk bigint, " + ", ".join(f"{p} double" for p in pops))
    sources, outgroups = [f"s{k}" for k in range(s)], [f"o{k}" for k in range(6)]
    got, bad = models.mixtures(models.product_sums(df, pops), pops, [("t", sources, outgroups), ("t", sources, outgroups[:1])])
    f4 = lambda a, b, c, d, on: ((freq[a] - freq[b]) * (freq[c] - freq[d]))[on].mean()

    def solved(on):
        y = [f4("t", "s0", "o0", c, on) for c in outgroups[1:]]
        a = [[f4(x, "s0", "o0", c, on) for x in sources[1:]] for c in outgroups[1:]]
        w = np.linalg.lstsq(np.array(a), np.array(y), rcond=None)[0]
        return np.concatenate([[1 - w.sum()], w])

    assert got["n"] == (~gap).sum() and got["dof"] == 6 - s
    assert got["weights"] == pytest.approx(solved(~gap), rel=1e-6)
    loo = np.array([solved(~gap & (blk != b)) for b in range(20)])
    assert got["se"] == pytest.approx(np.sqrt(19 / 20 * ((loo - loo.mean(0)) ** 2).sum(0)), rel=1e-5)
    assert got["weights"] == pytest.approx(weights, abs=0.05)
    assert np.isnan(bad["weights"]).all()


def test_thinning_ladder_is_nested(spark):
    from helixflow.operators import loci

    rows = loci.thinning_ladder(spark.range(20000).withColumnRenamed("id", "site"), "site", [0.05, 0.25, 1.0]).collect()
    held = {x: {r["site"] for r in rows if r["level"] == x} for x in (0.05, 0.25, 1.0)}
    assert held[0.05] < held[0.25] < held[1.0] and len(held[1.0]) == 20000 and len(rows) == sum(map(len, held.values()))
    assert len(held[0.05]) == pytest.approx(1000, abs=150) and len(held[0.25]) == pytest.approx(5000, abs=300)


@pytest.mark.parametrize("parts", [1, 5])
def test_running_totals_over_ranges(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(0, 50, 200))]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "i bigint, v bigint").repartition(3)
        got = ordinals.running(ordinals.running(df, ["i"], "v", "up"), [F.col("i").desc()], "v", "low", "min").orderBy("i").collect()
        assert ordinals.running(df.limit(0), ["i"], "v", "up").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    v = np.array([x for _, x in rows])
    assert [r["up"] for r in got] == np.cumsum(v).tolist()
    assert [r["low"] for r in got] == np.minimum.accumulate(v[::-1])[::-1].tolist()


def test_ranks_within_groups_and_adjusted_p(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(g), float(v)) for i, (g, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 300), rng.integers(0, 20, 300)))]
    df = spark.createDataFrame([*rows, (999, 0, None)], "i bigint, g int, v double")
    got = {r["i"]: r["r"] for r in aggregates.average_rank(df, "v", "r", ["g"]).collect()}
    assert got == {i: 1 + sum(h == g and w < v for _, h, w in rows) + (sum(h == g and w == v for _, h, w in rows) - 1) / 2 for i, g, v in rows}
    z = [0.0, 1e-9, 0.3, 1.0, 1.4999, 1.5, 1.96, 2.5, 4.0, 7.0, 12.0, -1.96, -0.3]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").withColumn("p", aggregates.two_sided_p(F.col("z")))
    p = [math.erfc(abs(x) / math.sqrt(2)) for x in z]
    assert np.allclose([r["p"] for r in frame.orderBy("i").collect()], p, rtol=1e-11, atol=0)
    q = [min(1.0, min(p[j] * len(p) / sum(y <= p[j] * (1 + 1e-12) for y in p) for j in range(len(p)) if p[j] >= p[i] * (1 - 1e-12))) for i in range(len(p))]
    assert np.allclose([r["q"] for r in aggregates.benjamini_hochberg(frame, "p").orderBy("i").collect()], q, rtol=1e-9)


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=90)
    fold = np.arange(90) % 4
    df = spark.createDataFrame([(*map(float, a), float(b), int(f)) for a, b, f in zip(x, y, fold)], "a double, b double, c double, y double, fold int")
    for f, r2 in models.ridge_cv(df, F.col("y"), [F.col(c) for c in "abc"], "fold", 2.0):
        on, off = fold != f, fold == f
        m, k = x[on].mean(0), y[on].mean()
        w = np.linalg.solve((x[on] - m).T @ (x[on] - m) + 2 * np.eye(3), (x[on] - m).T @ (y[on] - k))
        miss = y[off] - k - (x[off] - m) @ w
        assert abs(r2 - (1 - miss @ miss / ((y[off] - y[off].mean()) ** 2).sum())) < 1e-9


def test_mds_keeps_distances():
    at = np.random.default_rng(6).normal(size=(12, 2))
    gaps = lambda v: np.linalg.norm(v[:, None] - v[None], axis=2)
    assert np.allclose(gaps(models.mds(gaps(at), 2)), gaps(at))
    assert models.mds(np.where(np.eye(12, k=1) > 0, np.nan, gaps(at))).shape == (12, 2)


def test_equal_means_are_equal_whatever_the_order(spark):
    from helixflow.operators import frequency

    values = {1: [0.01, 0.09, 0.05, 0.03, 0.07], 2: [0.07, 0.03, 0.01, 0.05, 0.09], 3: [0.07, 0.07, 0.07], 4: [0.02, None, 0.05], 5: [0.04]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "id int, v double")
    got = {r["id"]: (r["m"], r["e"]) for r in df.groupBy("id").agg(frequency.exact_mean("v").alias("m"), frequency.exact_se("v").alias("e")).collect()}
    assert got[1] == got[2] and got[1][0] == 0.05
    assert got[1][1] == pytest.approx(np.std(values[1], ddof=1) / 5**0.5, rel=1e-12)
    assert got[3] == (0.07, 0.0)
    assert got[4] == (0.035, pytest.approx(0.015, rel=1e-12))
    assert got[5] == (0.04, None)


def test_estimates_without_spread_are_left_out(spark, tmp_path):
    """Three equal discounts have no spread, whatever floating sums would leave."""
    from helixflow.plans import views

    rows = [(i, i * 3 + j, 0.07 if i else 0.05 + 0.01 * j) for i in range(2) for j in range(3)]
    spark.createDataFrame([(o, d) for _, o, d in rows], "l_orderkey bigint, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.createDataFrame([(o, i) for i, o, _ in rows], "o_orderkey bigint, o_custkey bigint").withColumn("o_orderdate", F.lit("2001-01-01").cast("timestamp"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = views.estimates(spark, str(tmp_path)).collect()
    assert [(r["id"], r["alpha"], r["n"]) for r in got] == [(0, 0.06, 3)]


def test_informative_at_its_bounds(spark):
    from helixflow.operators import loci

    # 1 - 0.7 is over 0.3 and 1 - 0.9 is under 0.1 in doubles; (0.1 + 0.5) / 2 and (0.2 + 0.4) / 2 differ
    rows = [(1, 0.2, 0.4, 0.6), (2, 0.1, 0.5, 0.6), (3, 0.1, 0.1, 0.9), (4, 0.7, 0.7, 0.1), (5, 0.31, 0.31, 0.9)]
    w = spark.createDataFrame(rows, "site int, altai double, vindija double, mbuti double")
    found = lambda e, a: [r["site"] for r in loci.informative(w, e, a).filter("informative").orderBy("site").collect()]
    assert found(0.7, 0.45) == [1, 2, 3, 4]
    assert found(0.9, 0.1) == [3]


def test_kinship_tiles_meet_only_where_both_have_calls(spark):
    """40 families without a site in common: bits were copied to all tiles, now to those of their own block."""
    from helixflow.operators import kinship

    packed = spark.range(160).selectExpr("id as ind", "cast(id / 4 as int) as tile", "cast(id / 4 as bigint) as block", "array(named_struct('w', 0, 'c', 1L, 'a', 0L)) as x")
    met = kinship._meetings(packed)
    assert met.count() == 160 and met.filter("lo <> hi").isEmpty()
    calls = spark.range(40 * 4 * 64).selectExpr("id div 4 as site", "id div 256 * 4 + id % 4 as ind", "cast(id % 3 = 0 as int) as a")
    got = kinship.mismatch(calls, 3, tile=4, words=1)
    assert got.count() == 40 * 6 and got.agg(F.min("n"), F.max("n")).first()[:] == (64, 64)


def test_site_parts_as_matrices(spark):
    """Products over calls alone equal those of the full matrix, whose missing calls are the site's mean."""
    rng = np.random.default_rng(3)
    calls = [(s, i, int(g)) for s in range(60) for i, g in enumerate(rng.integers(0, 3, 70)) if rng.random() < (0.1 if s % 2 else 0.9)]
    ids, rows = models.site_rows(spark.createDataFrame(calls, "site bigint, ind bigint, g int"))
    n, m = len(ids), []
    for r in rows.collect():
        x = np.full(n, 2 * r["p"])
        x[r["no"]] = r["g"]
        m.append((x - 2 * r["p"]) / np.sqrt(2 * r["p"] * (1 - r["p"])))
    for scaled in (True, False):
        full = np.array(m) if scaled else np.array([x * np.sqrt(2 * r["p"] * (1 - r["p"])) + 2 * r["p"] for x, r in zip(m, rows.collect())])
        q = rng.standard_normal((n, 4))
        out, norm = models._through_sites(rows, q, scaled)
        assert np.allclose(out, full.T @ (full @ q)) and norm == pytest.approx((full**2).sum())
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    parts = list(models._sites(batch, n, most=40))
    assert {p.dense is None for p in parts} == {True, False} and max(len(p.p) for p in parts if p.dense is None) > 1
    assert sum(len(p.p) for p in parts) == len(m)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name, step, owner", [("perturb_k", "nearest", knn), ("explained_outliers", "analysis", None)])
def test_shared_steps_run_once(spark, monkeypatch, name, step, owner):
    from helixflow.plans import tables

    owner, met = owner or tables, []
    plain = getattr(owner, step)
    monkeypatch.setattr(owner, step, lambda *a, **k: met.append(1) or plain(*a, **k))
    assert tables.QUERIES[name](spark, "/root/testdata/sf0.001").count() and len(met) == 1


@pytest.mark.parametrize("kept", [10_000, 500])
def test_calls_hold_a_bounded_number_of_rows_a_task(spark, monkeypatch, kept):
    from helixflow import session
    from helixflow.plans import views

    monkeypatch.setattr(session, "ROWS_A_TASK", kept)
    d = "/root/testdata/sf0.001"
    got = views.calls(spark, d).withColumn("part", F.spark_partition_id())
    sizes = [r["n"] for r in got.groupBy("part").agg(F.count("*").alias("n")).collect()]
    plain = views.genotypes(spark, d).groupBy("site", "ind", "pop").agg(F.max("g").alias("g"))
    assert max(sizes) <= min(kept, sum(sizes) / 4) * 1.5
    assert got.drop("part").exceptAll(plain).isEmpty() and sum(sizes) == plain.count()


def test_nmf_components_holds_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    from helixflow import session
    from helixflow.plans import tables

    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    seen = []

    def kept(freq, cohort, k):
        seen.extend(r["n"] for r in freq.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count("*").alias("n")).collect())
        return [(0, [1.0] * k)]

    monkeypatch.setattr(models, "nmf_sites", kept)
    tables.nmf_components(spark, "/root/testdata/sf0.001")
    assert len(seen) > 8 and max(seen) <= 1000


def test_interval_join_moves_points_once_where_long_intervals_are_few(spark):
    from helixflow.operators import loci

    seen = [(0, [300, 120], [9, 3]), (1, [500, 70], [40, 9])]
    assert loci._merged(1000, seen) == {0: 0, 1: 0}
    assert loci._merged(400, seen) == {0: 0, 1: 1}
    assert loci._merged(10**9, [(0, [9], [9]), (4, [10**8, 0, 0, 0, 8], [10**8, 0, 0, 0, 8])]) == {0: 0, 4: 4}
    p = spark.range(5000).selectExpr("id as point", "1 as chrom", "id as pos")
    s = spark.range(300).selectExpr("id as span", "1 as chrom", "id * 16 as lo", "id * 16 + if(id = 7, 400, 20) as hi")
    joined = loci.interval_join(p, s, ["chrom"], "pos", "lo", "hi", bin_width=16)
    want = sum(min(hi, 4999) - lo + 1 for i in range(300) for lo, hi in [(i * 16, i * 16 + (400 if i == 7 else 20))])
    assert joined.count() == want
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_bh_adjusted_where_estimates_have_no_spread(spark, tmp_path):
    """Customers of equal discounts: Spark pulled the division by their error of 0 before the filter that drops them."""
    import duckdb

    from helixflow.plans import registry

    con, src = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("customer", "nation", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{src}/{t}.parquet'")
    same = "select l.* replace (case when o_custkey <= 10 then 0.05 when o_custkey <= 20 then 0.07 else l_discount end as l_discount)"
    con.execute(f"create table odd as {same} from lineitem l join orders on l_orderkey = o_orderkey")
    con.execute("create or replace view lineitem as select * from odd")
    for t in ("customer", "nation", "orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = registry.queries()["bh_adjusted"](spark, str(tmp_path)).select("id", "p", "q").collect()
    want = con.execute(f"select id, p, q from ({registry.oracle_sql()['bh_adjusted']})").fetchall()
    assert want and min(r[0] for r in want) > 20 and np.allclose(sorted(tuple(r) for r in got), sorted(want), rtol=0, atol=1.1e-6)
