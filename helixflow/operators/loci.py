"""Informative sites and markers, allele alignment, match rates with calibration, locus burdens, site subsets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ratio

C = F.col


def thinned(i: Column, k: int) -> Column:
    """Every k-th site."""
    return i % k == 0


def spaced(i: Column, n: Column, m: int) -> Column:
    """Whether i is one of m positions spread evenly over 0 .. n - 1, each cut to a whole number."""
    j = F.ceil(i * (m - 1) / F.nullif(n - 1, F.lit(0)))
    return (j < m) & (F.floor(j * (n - 1) / F.lit(float(m - 1))) == i)


def distances(freq: DataFrame, cohort: str, min_overlap: int) -> DataFrame:
    """(i, j, dist, overlap): mean squared difference over shared sites of each pair of cohorts."""
    f = freq.filter("p is not null")
    a, b = f.select("site", C(cohort).alias("i"), C("p").alias("pi")), f.select("site", C(cohort).alias("j"), C("p").alias("pj"))
    out = a.join(b, "site").filter("i < j").groupBy("i", "j").agg(F.avg((C("pi") - C("pj")) * (C("pi") - C("pj"))).alias("dist"), F.count(F.lit(1)).alias("overlap"))
    return out.select("i", "j", F.when(C("overlap") >= min_overlap, C("dist")).alias("dist"), "overlap")


def informative(w: DataFrame, extreme: float = 0.9, african: float = 0.1) -> DataFrame:
    """w with arch (mean of the archaic frequencies that are there), is_a1, afr (African frequency of that allele) and informative.

    Frequencies meet the bounds to nine decimal places, so one that is at a bound is at it however it was rounded.
    """
    arch = F.coalesce((C("altai") + C("vindija")) / 2, "altai", "vindija")
    near = lambda c: F.round(c, 9)
    out = w.withColumn("arch", arch).withColumn("is_a1", near("arch") > 0.5)
    out = out.withColumn("afr", F.when(C("is_a1"), C("mbuti")).otherwise(1 - C("mbuti")))
    return out.withColumn("informative", ((near("arch") >= extreme) | (near("arch") <= round(1 - extreme, 9))) & (near("afr") <= african))


def neanderthal_marker(a: Column, v: Column, chimp: Column, afr: Column, high: float = 0.99, chimp_high: float = 0.5, african: float = 0.05) -> Column:
    """Both archaics (nearly) fixed against the outgroup, and the allele rare in Africa."""
    up = (a > high) & (v > high) & (chimp < 1 - chimp_high)
    down = (a < 1 - high) & (v < 1 - high) & (chimp > chimp_high)
    return (up | down) & (F.when(a > high, afr).otherwise(1 - afr) < african)


def denisovan_marker(x: Column, a: Column, v: Column, chimp: Column, afr: Column, high: float = 0.99, african: float = 0.05) -> Column:
    """Derived in the Denisovan only."""
    up = (x > high) & (a < 0.5) & (v < 0.5) & (chimp < 0.5)
    down = (x < 1 - high) & (a > 0.5) & (v > 0.5) & (chimp > 0.5)
    return (up | down) & (F.when(x > high, afr).otherwise(1 - afr) < african)


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def aligned(rows: DataFrame) -> DataFrame:
    """rows of (a1, a2, b1, b2) with status and f, the frequency of a1 in the call (b1, b2), after a strand flip if need be."""
    ok = C("b1").isin(*"ACGT") & C("b2").isin(*"ACGT")
    fits = lambda x, y: x.isin(C("a1"), C("a2")) & y.isin(C("a1"), C("a2"))
    share = lambda x, y: ((x == C("a1")).cast("int") + (y == C("a1")).cast("int")) / 2.0
    c1, c2 = complement(C("b1")), complement(C("b2"))
    status = F.when(C("a1") == complement(C("a2")), "ambiguous").when(~ok, "mismatch").when(fits(C("b1"), C("b2")), "used").when(fits(c1, c2), "flipped").otherwise("mismatch")
    out = rows.withColumn("status", status)
    return out.withColumn("f", F.when(C("status") == "used", share(C("b1"), C("b2"))).when(C("status") == "flipped", share(c1, c2)))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by order of each key; unlike dropDuplicates, the same one each time."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("__r")).select(*keys, "__r.*")


def doses(calls: DataFrame, info: DataFrame) -> DataFrame:
    """(site, ind, chrom, dose): copies of the archaic allele at informative sites."""
    rows = calls.filter("g is not null").join(info.select("site", "chrom", "is_a1"), "site")
    return rows.select("site", "ind", "chrom", F.when(C("is_a1"), C("g")).otherwise(2 - C("g")).alias("dose"))


def burden(calls: DataFrame, info: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, burden, cov) over at least `least` covered sites."""
    return doses(calls, info).groupBy(*keys).agg((F.avg("dose") / 2).alias("burden"), F.count(F.lit(1)).alias("cov")).filter(C("cov") >= least)


def matches(info: DataFrame, genome: DataFrame) -> DataFrame:
    """(site, blk, chrom, is_a1, m): the genome's frequency of the archaic allele at informative sites that it covers."""
    rows = info.filter("informative").join(genome.filter("f is not null").select("site", "f"), "site")
    return rows.select("site", "blk", "chrom", "is_a1", F.when(C("is_a1"), C("f")).otherwise(1 - C("f")).alias("m"))


def calibrated(m: DataFrame, pops: DataFrame, pop: str, known: Column) -> DataFrame:
    """alpha of the genome from its match rate by a line through populations of known alpha, refitted without each block for the SE.

    m: (blk, m) of the genome; pops: (pop, blk, f). The left-out fits are one grouped regression over block sums.
    """
    sums = pops.groupBy(pop, "blk").agg(F.sum("f").alias("s"), F.count(F.lit(1)).alias("c"))
    totals = sums.groupBy(pop).agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    own = m.groupBy("blk").agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("c"))
    every = own.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    folds = own.select("blk").union(own.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("blk")))
    rates = folds.crossJoin(F.broadcast(totals)).join(sums, [pop, "blk"], "left")  # blocks x populations, both fixed
    left = lambda: ratio(C("ts") - F.coalesce("s", F.lit(0.0)), C("tc") - F.coalesce("c", F.lit(0)))
    rates = rates.select("blk", left().alias("rate"), known.alias("known"))
    line = rates.groupBy("blk").agg(F.regr_slope("known", "rate").alias("slope"), F.regr_intercept("known", "rate").alias("intercept"))
    pred = line.crossJoin(F.broadcast(every)).join(own, "blk", "left").withColumn("p", C("intercept") + C("slope") * left())
    whole, fold = C("blk") == -1, C("blk") >= 0
    se = F.sqrt((F.count_if(fold) - 1) * F.var_pop(F.when(fold, C("p"))))
    pick = lambda c: F.max(F.when(whole, C(c)))
    return pred.agg(pick("p").alias("alpha"), se.alias("se"), pick("slope").alias("slope"), pick("intercept").alias("intercept"), F.count_if(fold).alias("blocks"))


def thinning_ladder(df: DataFrame, site: str, levels: list[float], seed: int = 0, to: str = "level") -> DataFrame:
    """df once for each level whose share of sites a row's site is in; one draw a site, so smaller levels are nested in larger.

    A site's draw is a hash of its number, so runs agree; a level of 1 or more holds all rows.
    """
    prime = 2147483647
    draw = ((F.col(site) % prime * 48271 + seed * 69621 + 11) % prime * 16807 % prime) * 40692 % prime
    rungs = F.array(*[F.when(draw < int(min(x, 1.0) * prime), F.lit(float(x))) for x in levels])
    return df.withColumn(to, F.explode(F.array_compact(rungs)))


#: Width of the finest bins of interval_join, how much wider each level is than the one before, and levels.
BIN, WIDER, LEVELS = 1 << 14, 8, 12
#: Bins that an interval of a merged level may touch.
MOST_BINS = 1 << 10


def _merged(points: int, seen: list) -> dict[int, int]:
    """The level that the intervals of each level in use take, so that fewest rows are moved.

    seen: for each level in use, in order, its number and for it and each finer level the bins that its intervals touch and
    the most of one. Points are moved once for each level, intervals once for each bin.
    """
    best = None
    for k in range(1, len(seen) + 1):
        for kept in combinations([r[0] for r in seen], k):
            to = {r[0]: max((x for x in kept if x <= r[0]), default=None) for r in seen}
            if None in to.values() or any(r[2][to[r[0]]] > MOST_BINS for r in seen if to[r[0]] != r[0]):
                continue
            cost = points * k + sum(r[1][to[r[0]]] for r in seen)
            if best is None or cost < best[0]:
                best = (cost, to)
    return best[1] if best else {}


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, *, closed: bool = True, bin_width: int = BIN) -> DataFrame:
    """Each point (keys, at) with each interval of its keys that holds it; closed: end belongs to the interval.

    An interval takes the finest level of bins of which it touches at most WIDER + 1, and is joined to the points of these
    bins by equality, so neither long nor many overlapping intervals need a comparison with all points. Points are
    repeated once for each level in use, so a level of few intervals is merged into a finer one where that moves fewer
    rows. Both sides are shuffled: their bins are far more rows than the tables whose size a broadcast would go by. An
    interval and a point meet in one bin at most, so no row comes twice. NULLs and intervals whose end is before their
    start hold nothing. The other columns of both sides are kept.
    """
    width = [bin_width * WIDER**k for k in range(LEVELS)]
    first, last = F.col(start), F.col(end)
    touched = [F.floor(last / w) - F.floor(first / w) for w in width]
    level = F.coalesce(*(F.when(t <= WIDER, k) for k, t in enumerate(touched)), F.lit(LEVELS - 1))
    placed = intervals.filter(last >= first).withColumn("__level", level)
    bins = [t + 1 for t in touched]
    seen = placed.groupBy("__level").agg(F.array(*map(F.sum, bins)), F.array(*map(F.max, bins))).orderBy("__level").collect()  # at most LEVELS
    to = _merged(points.count(), seen)
    used = sorted(set(to.values()))
    if to:
        placed = placed.withColumn("__level", F.element_at(F.create_map(*(F.lit(v) for kv in to.items() for v in kv)), F.col("__level")))
    wide = F.element_at(F.lit(width).cast("array<bigint>"), F.col("__level") + 1)
    placed = placed.withColumn("__bin", F.explode(F.sequence(F.floor(first / wide), F.floor(last / wide))))
    spots = [F.struct(F.lit(k).alias("__level"), F.floor(F.col(at) / width[k]).alias("__bin")) for k in used]
    if not spots:
        spots = [F.struct(F.lit(0).alias("__level"), F.lit(0).cast("bigint").alias("__bin"))]
    dealt = points.filter(F.col(at).isNotNull()).withColumn("__spot", F.explode(F.array(*spots))).select(*points.columns, "__spot.*")
    inside = (F.col(at) >= first) & ((F.col(at) <= last) if closed else (F.col(at) < last))
    return dealt.join(placed.hint("merge"), [*keys, "__level", "__bin"]).filter(inside).drop("__level", "__bin")
