"""Frequency, statistics, locus and kinship queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequency, gates, jackknife, kinship, loci
from ..operators.ordinals import numbered
from .views import calls, ctes, estimates, genotypes, jackknife_sql, rounded, sites, table, wide

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col


def query(sql: str | None = None, queries: dict = QUERIES, oracles: dict = ORACLES):
    """Registers a query under its name, with its SQL."""

    def add(f):
        queries[f.__name__] = f
        if sql:
            oracles[f.__name__] = sql
        return f

    return add


@query(ctes("freq") + " select site, pop, round(p, 6) as p, n from freq")
def allele_freq(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frequency.allele_frequency(genotypes(spark, d), "site", "pop"))


@query(ctes("geno") + ", m as (select nat, count(distinct ind) as members from geno group by nat) select site, g.nat, round(case when max(members) >= 4 then avg(g) / 2 end, 6) as p, count(g) as n, max(members) as members from geno g join m on g.nat = m.nat group by site, g.nat")
def cohort_freq_min_ind(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frequency.cohort_frequency(genotypes(spark, d), "nat", min_ind=4).select("site", "nat", "p", "n", "members"))


@query(ctes("sites") + " select site, blk from sites")
def block_assign(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("site", "blk")


@query(ctes("wide") + " select site, round((altai - chimp) * (x - mbuti), 6) as f4, round((altai - vindija) * (x - mbuti), 6) as f4_va from wide")
def f4_site(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d)
    return rounded(w.select("site", jackknife.f4(C("altai"), C("chimp"), C("x"), C("mbuti")).alias("f4"), jackknife.f4(C("altai"), C("vindija"), C("x"), C("mbuti")).alias("f4_va")))


_D = {"d": ("(altai - chimp) * (x - mbuti)", "(altai + chimp - 2 * altai * chimp) * (x + mbuti - 2 * x * mbuti)")}
_JK = "round(theta_{0}, 6) as theta_{0}, round(se_{0}, 6) as se_{0}, round(z_{0}, 4) as z_{0}, sites_{0}, blocks_{0}"


@query(ctes("wide") + ", " + jackknife_sql("wide", [], _D) + " select " + _JK.format("d") + " from jk")
def dstat_jackknife(spark: SparkSession, d: str) -> DataFrame:
    s = jackknife.dstat("d", C("altai"), C("chimp"), C("x"), C("mbuti"))
    return rounded(jackknife.jackknife(wide(spark, d), [s], []), z_d=4)


_LEVELS = (0.02, 0.05, 0.1, 0.25, 0.5, 1.0)
_RUNGS = f"list_filter([{', '.join(map(str, _LEVELS))}], lambda x: ((((site * 48271 + 11) % 2147483647) * 16807 % 2147483647) * 40692) % 2147483647 < cast(floor(x * 2147483647) as bigint))"


@query(ctes("wide") + f", lad as (select *, unnest({_RUNGS}) as level from wide), " + jackknife_sql("lad", ["level"], _D) + " select cast(level as double) as level, " + _JK.format("d") + " from jk")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    """The D statistic and its error on nested shares of the sites, all from one pass."""
    s = jackknife.dstat("d", C("altai"), C("chimp"), C("x"), C("mbuti"))
    return rounded(jackknife.jackknife(loci.thinning_ladder(wide(spark, d), "site", list(_LEVELS)), [s], ["level"]), z_d=4)


_A = {"a": ("(altai - chimp) * (x - mbuti)", "(altai - chimp) * (vindija - mbuti)")}


@query(ctes("wide") + ", " + jackknife_sql("wide", [], _A) + " select " + _JK.format("a") + " from jk")
def f4_ratio_jackknife(spark: SparkSession, d: str) -> DataFrame:
    s = jackknife.f4_ratio("a", C("altai"), C("chimp"), C("x"), C("mbuti"), C("vindija"))
    return rounded(jackknife.jackknife(wide(spark, d), [s], []), z_a=4)


def _three(x: str) -> list[jackknife.Statistic]:
    return [
        jackknife.f4_ratio("a", C("altai"), C("chimp"), C(x), C("mbuti"), C("vindija")),
        jackknife.dstat("nea", C("altai"), C("chimp"), C(x), C("mbuti")),
        jackknife.dstat("den", C("vindija"), C("chimp"), C(x), C("mbuti")),
    ]


def _three_sql(x: str) -> dict[str, tuple[str, str]]:
    d = lambda w: (f"({w} - chimp) * ({x} - mbuti)", f"({w} + chimp - 2 * {w} * chimp) * ({x} + mbuti - 2 * {x} * mbuti)")
    return {"a": (f"(altai - chimp) * ({x} - mbuti)", "(altai - chimp) * (vindija - mbuti)"), "nea": d("altai"), "den": d("vindija")}


_THREE = ", ".join(_JK.format(s) for s in ("a", "nea", "den"))


@query(ctes("wide") + ", px as (select site, ind, avg(g) / 2 as px from geno group by site, ind), w2 as (select ind, px, w.* from px join wide w on px.site = w.site), " + jackknife_sql("w2", ["ind"], _three_sql("px")) + f" select ind, {_THREE} from jk")
def per_sample_three_stats(spark: SparkSession, d: str) -> DataFrame:
    px = frequency.allele_frequency(genotypes(spark, d), "site", "ind").select("site", "ind", C("p").alias("px"))
    return rounded(jackknife.jackknife(px.join(wide(spark, d), "site"), _three("px"), ["ind"]), z_a=4, z_nea=4, z_den=4)


@query(ctes("wide") + ", px as (select site, nat, avg(g) / 2 as px from geno group by site, nat), w2 as (select nat, px, w.* from px join wide w on px.site = w.site), " + jackknife_sql("w2", ["nat"], _three_sql("px")) + f" select nat, {_THREE} from jk")
def group_archaic(spark: SparkSession, d: str) -> DataFrame:
    px = frequency.allele_frequency(genotypes(spark, d), "site", "nat").select("site", "nat", C("p").alias("px"))
    return rounded(jackknife.jackknife(px.join(wide(spark, d), "site"), _three("px"), ["nat"]), z_a=4, z_nea=4, z_den=4)


_GATES = [
    gates.Gate("carriers", "z_nea", (0, 5, 10), low=3.0, strict=True),
    gates.Gate("share in range", "theta_a", tuple(range(9)), low=0.012, high=0.035, needed=8),
    gates.Gate("near zero", "theta_nea", (2, 3, 4, 7, 8), low=-0.02, high=0.02, needed=4),
    gates.Gate("control", "z_nea", (2, 7), high=4.0, strict=True, absolute=True),
    gates.Gate("rank order", "theta_nea", (1, 2, 0), ordered=True),
    gates.Gate("turned order", "theta_nea", (0, 2, 1), ordered=True),
    gates.Gate("far above", "theta_den", (2, 3), ordered=True, margin=2.0),
    gates.Gate("unknown member", "theta_den", (2, 99)),
]
_GATED = ("theta_a", "theta_nea", "z_nea", "theta_den")


def _literal(x) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_GATE_ROWS = ", ".join("(" + ", ".join(_literal(v) for v in (g.name, g.statistic, m, k, g.low, g.high, g.strict, g.absolute, g.needed or len(g.members), g.ordered, g.margin)) + ")" for g in _GATES for k, m in enumerate(g.members))


@query(
    f"""with ga as ({ORACLES["group_archaic"]}), es as ({" union all ".join(f"select nat as member, '{s}' as statistic, cast({s} as double) as value from ga" for s in _GATED)}),
    gt(gate, statistic, member, place, low, high, strict, absolute, needed, ordered, margin) as (values {_GATE_ROWS}),
    r as (select gt.*, value, lag(value) over (partition by gate order by place) as prior, case when absolute then abs(value) else value end as x from gt left join es on gt.statistic = es.statistic and gt.member = es.member),
    f as (select *, case when value is null then false when ordered then place = 0 or coalesce(value > prior + margin * greatest(abs(prior), 0.000001), false)
      else coalesce(case when strict then x > low else x >= low end, true) and coalesce(case when strict then x < high else x <= high end, true) end as fits from r)
    select gate, count(case when fits then 1 end) as met, cast(max(needed) as integer) as needed, min(value) as least, max(value) as most, count(case when fits then 1 end) >= max(needed) as passed from f group by gate"""
)
def validation_gates(spark: SparkSession, d: str) -> DataFrame:
    """Declared gates over the cohorts' estimates: ranges, controls and rank orders, some of which fail."""
    estimates = group_archaic(spark, d)
    long = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), C(s).alias("value")) for s in _GATED])).alias("e")
    return gates.judged(estimates.select(C("nat").cast("bigint").alias("member"), long).select("member", "e.*"), gates.gate_table(spark, _GATES, "bigint"))


_TUPLES = (("x", "mbuti", "altai", "chimp"), ("x", "vindija", "altai", "chimp"), ("x", "mbuti", "vindija", "chimp"), ("mbuti", "vindija", "altai", "x"))


@query(
    ctes("wide")
    + ", w2 as ("
    + " union all ".join(f"select '{a}_{b}_{c}_{e}' as contrast, blk, {a} as a, {b} as b, {c} as c, {e} as e from wide" for a, b, c, e in _TUPLES)
    + "), "
    + jackknife_sql("w2", ["contrast"], {"d": ("(a - b) * (c - e)", "(a + b - 2 * a * b) * (c + e - 2 * c * e)")})
    + " select contrast, "
    + _JK.format("d")
    + " from jk"
)
def d_contrasts(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit("_".join(t)).alias("contrast"), *(C(p).alias(n) for p, n in zip(t, "abce"))) for t in _TUPLES])
    w = wide(spark, d).select("blk", F.explode(rows).alias("r")).select("blk", "r.*")
    return rounded(jackknife.jackknife(w, [jackknife.dstat("d", C("a"), C("b"), C("c"), C("e"))], ["contrast"]), z_d=4)


@query(ctes("wide") + ", " + jackknife_sql("wide", [], {"m": ("x", "case when x is not null then 1.0 end")}) + " select " + _JK.format("m") + " from jk")
def mean_jackknife(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jackknife.jackknife(wide(spark, d), [jackknife.mean("m", C("x"))], []), z_m=4)


@query(
    ctes("wide")
    + """ select blk, count(*) as n, round(sum((x - altai) * (chimp - mbuti)), 6) as y_mbuti, round(sum((x - altai) * (chimp - vindija)), 6) as y_vindija,
    round(sum((vindija - altai) * (chimp - mbuti)), 6) as a_mbuti, round(sum((mbuti - altai) * (chimp - vindija)), 6) as a_vindija
    from wide where altai is not null and chimp is not null and mbuti is not null and vindija is not null and x is not null group by blk"""
)
def qpadm_block_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums and counts of the f4 products for a mixture solve, over sites with all populations."""
    w = wide(spark, d).dropna(subset=["altai", "chimp", "mbuti", "vindija", "x"])
    f4 = lambda t, r: F.sum((C(t) - C("altai")) * (C("chimp") - C(r)))
    return rounded(w.groupBy("blk").agg(F.count(F.lit(1)).alias("n"), f4("x", "mbuti").alias("y_mbuti"), f4("x", "vindija").alias("y_vindija"), f4("vindija", "mbuti").alias("a_mbuti"), f4("mbuti", "vindija").alias("a_vindija")))


_AGE = "case when bp >= 0 and bp < 800 then 'late' when bp >= 800 and bp < 1600 then 'middle' when bp >= 1600 then 'early' end"


@query(
    ctes("wide")
    + f""", og as (select o_orderkey, date_diff('day', o_orderdate::date, DATE '2002-01-01') as bp from orders),
    lg as (select l_partkey as site, {_AGE} as bin, case when (l_orderkey + l_linenumber) % 11 = 0 then null else (l_orderkey + l_partkey) % 3 end as g from lineitem join og on l_orderkey = o_orderkey),
    px as (select site, bin, avg(g) / 2 as px from lg group by site, bin), w2 as (select bin, px, w.* from px join wide w on px.site = w.site), """
    + jackknife_sql("w2", ["bin"], _three_sql("px"))
    + f" select bin, {_THREE} from jk"
)
def temporal_group(spark: SparkSession, d: str) -> DataFrame:
    og = table(spark, d, "orders").selectExpr("o_orderkey", "datediff(DATE'2002-01-01', o_orderdate) as bp")
    lg = table(spark, d, "lineitem").join(og, F.expr("l_orderkey = o_orderkey"))
    lg = lg.selectExpr("l_partkey as site", f"{_AGE} as bin", "case when (l_orderkey + l_linenumber) % 11 = 0 then null else (l_orderkey + l_partkey) % 3 end as g")
    px = frequency.allele_frequency(lg, "site", "bin").select("site", "bin", C("p").alias("px"))
    return rounded(jackknife.jackknife(px.join(wide(spark, d), "site"), _three("px"), ["bin"]), z_a=4, z_nea=4, z_den=4)


@query(ctes("est") + " select id, round(alpha - 1.96 * se, 6) as lower, round(alpha + 1.96 * se, 6) as upper from est")
def ci_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(estimates(spark, d).select("id", (C("alpha") - 1.96 * C("se")).alias("lower"), (C("alpha") + 1.96 * C("se")).alias("upper")))


@query(ctes("calls") + ", h as (select ind, pop, count(case when g = 1 then 1 end) * 1.0 / count(g) as h from calls group by ind, pop having count(g) > 50) select pop, count(*) as n_ind, round(avg(h), 6) as het, round(stddev_pop(h) / sqrt(count(*)), 6) as het_se from h group by pop")
def heterozygosity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frequency.heterozygosity(calls(spark, d), "ind", "pop", 50))


@query(ctes("geno") + " select site, count(*) as n, round(avg(case when g is not null then 1.0 else 0.0 end), 6) as call_rate from geno group by site having avg(case when g is not null then 1.0 else 0.0 end) >= 0.9")
def call_rate(spark: SparkSession, d: str) -> DataFrame:
    per = genotypes(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg(C("g").isNotNull().cast("double")).alias("call_rate"))
    return rounded(per.filter("call_rate >= 0.9"))


@query("with s as (select p_partkey as site, row_number() over (order by p_partkey) - 1 as i, count(*) over () as n from part), w as (select distinct cast(floor(j * (n - 1) / 99.0) as bigint) as i from (select max(n) as n from s) cross join (select unnest(range(100)) as j)) select s.site, s.i, s.i % 12 = 0 as thinned from s where s.i % 12 = 0 or s.i in (select i from w)")
def site_subset(spark: SparkSession, d: str) -> DataFrame:
    """Every 12th site, and 100 sites evenly spaced (positions cut to whole numbers)."""
    s = table(spark, d, "part").select(C("p_partkey").alias("site"))
    s = numbered(s, ["site"], "i")
    s = s.filter(loci.thinned(C("i"), 12) | loci.spaced(C("i"), F.lit(s.count()), 100))
    return s.select("site", "i", loci.thinned(C("i"), 12).alias("thinned"))


@query(ctes("geno") + ", f as (select site, nat, avg(g) / 2 as p from geno group by site, nat) select a.nat as i, b.nat as j, round(case when count(*) >= 100 then avg((a.p - b.p) * (a.p - b.p)) end, 6) as dist, count(*) as overlap from f a join f b on a.site = b.site and a.nat < b.nat where a.p is not null and b.p is not null group by a.nat, b.nat")
def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    freq = frequency.allele_frequency(genotypes(spark, d), "site", "nat")
    return rounded(loci.distances(freq, "nat", 100))


_HAP = "case when g = 0 then 0 when g = 2 then 1 when g = 1 then (site * 31 + ind * 17) % 2 end"
_P0 = ctes("calls") + f", hap as (select site, ind, {_HAP} as a from calls), p0 as (select x.ind as i, y.ind as j, case when count(*) >= 3 then count(case when x.a <> y.a then 1 end) * 1.0 / count(*) end as p0, count(*) as n from hap x join hap y on x.site = y.site and x.ind < y.ind where x.a is not null and y.a is not null group by x.ind, y.ind)"
_DEG = ", med as (select median(p0) as med from p0), norm as (select i, j, p0, n, p0 / nullif(med, 0) as norm from p0 cross join med), deg as (select *, case when norm < 0.625 then 'identical/duplicate' when norm < 0.8125 then 'first-degree' when norm <= 0.90625 then 'second-degree' end as degree from norm)"


def _shared(spark: SparkSession, d: str) -> Callable[[int], DataFrame]:
    """Counts of shared sites. A call is the largest dosage, so its allele is the largest of its dosages' alleles."""
    coin = (C("site") * 31 + C("ind") * 17) % 2
    a = genotypes(spark, d).select("site", "ind", kinship.haploid(C("g"), coin).alias("a"))
    return kinship.shared(a, rows=table(spark, d, "lineitem").count(), inds=table(spark, d, "supplier").count())


def _degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of the pairs with enough sites; no other has one."""
    return kinship.degrees(kinship.rates(_shared(spark, d)(3), 3))


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    labels = kinship.clusters(table(spark, d, "supplier").select(C("s_suppkey").alias("ind")), _degrees(spark, d).filter(C("norm") < kinship.SECOND))
    cover = genotypes(spark, d).groupBy("ind").agg(F.avg(C("g").isNotNull().cast("double")).alias("coverage"))
    return rounded(kinship.prune(labels, cover).select("ind", "label", "coverage", "kept"))


@query(_P0 + " select i, j, round(p0, 6) as p0, n from p0")
def kinship_p0(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kinship.rates(_shared(spark, d)(1), 3))


@query(_P0 + _DEG + " select i, j, round(norm, 6) as norm, degree from deg where degree is not null")
def kinship_degree(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_degrees(spark, d).filter("degree is not null").select("i", "j", "norm", "degree"))


_PRUNE = (
    _P0.replace("with ", "with recursive ", 1)
    + _DEG
    + """, e as (select i, j from deg where norm < 0.8125 union select j, i from deg where norm < 0.8125),
    reach as (select s_suppkey as ind, s_suppkey as root from supplier union select e.j, r.root from reach r join e on r.ind = e.i),
    lab as (select ind, min(root) as label from reach group by ind), cov as (select ind, avg(case when g is not null then 1.0 else 0.0 end) as coverage from geno group by ind)
    select lab.ind, label, round(coverage, 6) as coverage, row_number() over (partition by label order by coverage desc, lab.ind) = 1 as kept from lab join cov on lab.ind = cov.ind"""
)


@query(_PRUNE)
def kinship_prune(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d)


@query(_P0 + " select i, j, round(p0, 6) as p0, n from p0")
def kinship_p0_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kinship.rates(_shared(spark, d)(1), 3))


@query(_P0 + _DEG + " select i, j, round(norm, 6) as norm, degree from deg")
def kinship_degree_all(spark: SparkSession, d: str) -> DataFrame:
    """Normalised mismatch and degree of all pairs, NULL where unrelated."""
    counted = _shared(spark, d)
    return rounded(kinship.degrees(kinship.rates(counted(1), 3), kinship.rates(counted(3), 3)).select("i", "j", "norm", "degree"))


@query(_PRUNE)
def kinship_prune_all(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d)


@query()
def haploidise_hash(spark: SparkSession, d: str) -> DataFrame:
    """Pseudo-haploid calls with a seeded hash as the coin."""
    coin = F.pmod(F.xxhash64(F.lit(0), "site", "ind"), F.lit(2))
    return calls(spark, d).select("site", "ind", "g", kinship.haploid(C("g"), coin).alias("a"))


_ARCH = "case when altai is null then vindija when vindija is null then altai else (altai + vindija) / 2 end"
_INFO = f", inf as (select *, {_ARCH} as arch, round({_ARCH}, 9) > 0.5 as is_a1, case when round({_ARCH}, 9) > 0.5 then mbuti else 1 - mbuti end as afr from wide), info as (select *, (round(arch, 9) >= 0.7 or round(arch, 9) <= 0.3) and round(afr, 9) <= 0.45 as informative from inf)"


@query(ctes("wide") + _INFO + " select site, round(arch, 6) as arch, is_a1, round(afr, 6) as afr, informative from info")
def informative_sites(spark: SparkSession, d: str) -> DataFrame:
    return rounded(loci.informative(wide(spark, d), extreme=0.7, african=0.45).select("site", "arch", "is_a1", "afr", "informative"))


@query(ctes("wide") + " select site, (altai > 0.6 and vindija > 0.6 and chimp < 0.45 or altai < 0.4 and vindija < 0.4 and chimp > 0.55) and (case when altai > 0.6 then mbuti else 1 - mbuti end) < 0.5 as nea, (x > 0.6 and altai < 0.5 and vindija < 0.5 and chimp < 0.5 or x < 0.4 and altai > 0.5 and vindija > 0.5 and chimp > 0.5) and (case when x > 0.6 then mbuti else 1 - mbuti end) < 0.5 as den from wide")
def markers(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d)
    nea = loci.neanderthal_marker(C("altai"), C("vindija"), C("chimp"), C("mbuti"), high=0.6, chimp_high=0.55, african=0.5)
    den = loci.denisovan_marker(C("x"), C("altai"), C("vindija"), C("chimp"), C("mbuti"), high=0.6, african=0.5)
    return w.select("site", nea.alias("nea"), den.alias("den"))


@query(ctes("wide") + ", dv as (select *, abs(chimp - 0.5) > 0.1 as polar, case when chimp < 0.5 then altai else 1 - altai end as d_alt, case when chimp < 0.5 then mbuti else 1 - mbuti end as d_afr from wide) select site, polar, round(d_alt, 6) as d_alt, round(d_afr, 6) as d_afr, polar and d_alt >= 0.5 and d_afr < 0.5 as nis from dv")
def nis_sites(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d).select("site", (F.abs(C("chimp") - 0.5) > 0.1).alias("polar"), frequency.derived(C("altai"), C("chimp")).alias("d_alt"), frequency.derived(C("mbuti"), C("chimp")).alias("d_afr"))
    return rounded(w.withColumn("nis", C("polar") & (C("d_alt") >= 0.5) & (C("d_afr") < 0.5)))


_BURDEN = ctes("wide", "calls") + _INFO + ", dose as (select c.ind, i.site, i.chrom, case when is_a1 then g else 2 - g end as dose from calls c join info i on c.site = i.site where informative and g is not null)"


@query(_BURDEN + " select ind, round(avg(dose) / 2, 6) as burden, count(*) as cov from dose group by ind having count(*) >= 3")
def locus_burden(spark: SparkSession, d: str) -> DataFrame:
    info = loci.informative(wide(spark, d), extreme=0.7, african=0.45).filter("informative")
    return rounded(loci.burden(calls(spark, d), info, ["ind"], 3))


@query(_BURDEN + ", per as (select chrom, site, avg(dose) / 2 as f from dose group by chrom, site), pool as (select chrom, avg(dose) / 2 as pooled, count(*) as n from dose group by chrom) select per.chrom, count(*) as n_site, round(avg(f), 6) as per_site, round(max(pooled), 6) as pooled, max(n) as n from per join pool on per.chrom = pool.chrom group by per.chrom")
def locus_by_bin(spark: SparkSession, d: str) -> DataFrame:
    info = loci.informative(wide(spark, d), extreme=0.7, african=0.45).filter("informative")
    dose = loci.doses(calls(spark, d), info)
    per = dose.groupBy("chrom", "site").agg((F.sum("dose") / 2).alias("s"), F.count(F.lit(1)).alias("c"))
    out = per.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_site"), F.avg(C("s") / C("c")).alias("per_site"), (F.sum("s") / F.sum("c")).alias("pooled"), F.sum("c").alias("n"))
    return rounded(out)


_BASES = {"spark": "substring('ACGT', cast({0} % 4 as int) + 1, 1)", "duck": "substring('ACGT', cast({0} % 4 as int) + 1, 1)"}
_A1, _A2 = "substring('ACGT', cast(p_partkey % 4 as int) + 1, 1)", "substring('ACGT', cast((p_partkey + 1 + p_size % 3) % 4 as int) + 1, 1)"
_B1, _B2 = "substring('ACGT-', cast((p_partkey * 7 + p_size) % 5 as int) + 1, 1)", "substring('ACGT', cast((p_partkey * 3 + p_size) % 4 as int) + 1, 1)"
_COMP = "translate({}, 'ACGT', 'TGCA')"
_ALLELES = f"al as (select p_partkey as site, p_size as chrom, {_A1} as a1, {_A2} as a2, {_B1} as b1, {_B2} as b2 from part)"
_ALIGN = (
    _ALLELES
    + f""", st as (select *, case when a1 = {_COMP.format('a2')} then 'ambiguous' when b1 not in ('A','C','G','T') or b2 not in ('A','C','G','T') then 'mismatch'
    when b1 in (a1, a2) and b2 in (a1, a2) then 'used' when {_COMP.format('b1')} in (a1, a2) and {_COMP.format('b2')} in (a1, a2) then 'flipped' else 'mismatch' end as status from al),
    fr as (select *, case status when 'used' then (case when b1 = a1 then 1 else 0 end + case when b2 = a1 then 1 else 0 end) / 2.0
    when 'flipped' then (case when {_COMP.format('b1')} = a1 then 1 else 0 end + case when {_COMP.format('b2')} = a1 then 1 else 0 end) / 2.0 end as f from st)"""
)


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey as site", "p_size as chrom", f"{_A1} as a1", f"{_A2} as a2", f"{_B1} as b1", f"{_B2} as b2")
    return loci.aligned(part)


@query("with " + _ALIGN + " select site, a1, a2, b1, b2, status, cast(f as double) as f from fr")
def allele_align(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).select("site", "a1", "a2", "b1", "b2", "status", "f")


@query("with " + _ALIGN + " select status, count(*) as n from fr group by status")
def align_counters(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_CONS = ctes("wide") + _INFO + ", " + _ALIGN + ", mk as (select i.site, i.blk, i.chrom, case when is_a1 then f else 1 - f end as m from info i join fr on i.site = fr.site where informative and f is not null)"


@query(_CONS + " select chrom, count(*) as n, round(avg(m), 6) as rate from mk group by chrom having count(*) >= 3")
def per_chrom_match(spark: SparkSession, d: str) -> DataFrame:
    m = loci.matches(loci.informative(wide(spark, d), extreme=0.7, african=0.45), _aligned(spark, d))
    return rounded(m.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("rate")).filter("n >= 3"))


@query(
    _CONS
    + """, pm as (select nat, mk.site, mk.blk, avg(case when is_a1 then g else 2 - g end) / 2 as f from mk join info i on mk.site = i.site join geno g on g.site = mk.site where g is not null group by nat, mk.site, mk.blk),
    bs as (select nat, blk, sum(f) as s, count(*) as c from pm group by nat, blk), tot as (select nat, sum(s) as ts, sum(c) as tc from bs group by nat),
    tb as (select blk, sum(m) as s, count(*) as c from mk group by blk), tt as (select sum(s) as ts, sum(c) as tc from tb),
    fold as (select blk from tb union all select -1),
    rates as (select fold.blk, t.nat, (ts - coalesce(b.s, 0)) / nullif(tc - coalesce(b.c, 0), 0) as rate, nat * 0.001 as known from fold cross join tot t left join bs b using (nat, blk)),
    line as (select blk, regr_slope(known, rate) as slope, regr_intercept(known, rate) as intercept from rates group by blk),
    pred as (select l.blk, slope, intercept, intercept + slope * (tt.ts - coalesce(tb.s, 0)) / nullif(tt.tc - coalesce(tb.c, 0), 0) as p from line l cross join tt left join tb on tb.blk = l.blk)
    select round(max(case when blk = -1 then p end), 6) as alpha, round(sqrt((count(case when blk >= 0 then 1 end) - 1) * var_pop(case when blk >= 0 then p end)), 6) as se, round(max(case when blk = -1 then slope end), 6) as slope, round(max(case when blk = -1 then intercept end), 6) as intercept, count(case when blk >= 0 then 1 end) as blocks from pred"""
)
def match_rate_calibration(spark: SparkSession, d: str) -> DataFrame:
    m = loci.matches(loci.informative(wide(spark, d), extreme=0.7, african=0.45), _aligned(spark, d))
    pops = m.select("site", "blk", "is_a1").join(genotypes(spark, d).filter("g is not null"), "site")
    pops = pops.groupBy("nat", "site", "blk").agg((F.avg(F.when(C("is_a1"), C("g")).otherwise(2 - C("g"))) / 2).alias("f"))
    return rounded(loci.calibrated(m, pops, "nat", C("nat") * 0.001))
