"""Genotype-like views over the driver's tables, the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequency, jackknife
from ..session import dealt

POPS = {0: "altai", 1: "chimp", 2: "mbuti", 3: "vindija", 4: "x"}

# SQL text that both engines read alike.
_DOSAGE = "case when (l_orderkey + l_linenumber) % 11 = 0 then null else (l_orderkey + l_partkey * (1 + n_regionkey)) % 3 end"
_BP = {"spark": "datediff(DATE'2002-01-01', o_orderdate)", "duck": "date_diff('day', o_orderdate::date, DATE '2002-01-01')"}
META = {
    "id": "c_custkey",
    "genetic_id": "concat(c_name, case c_custkey % 7 when 0 then '.HO' when 1 then '.AG' when 2 then '.AG' when 3 then '.SG' when 4 then '' else '.DG' end)",
    "group_id": "concat(case c_custkey % 23 when 0 then 'Neanderthal_' when 1 then 'Chimp_' when 2 then 'Italy_IUP_' when 3 then 'Etruscan_' else '' end, n_name, '_', c_mktsegment, case when c_custkey % 6 = 0 then '-o' else '' end)",
    "country": "case c_custkey % 9 when 0 then 'Papua New Guinea' when 1 then 'Peru' when 2 then 'Kenya' when 3 then null when 4 then '' else n_name end",
    "lat": "case when c_custkey % 13 = 0 then null else cast((c_custkey * 37) % 1400 as double) / 10 - 60 end",
    "lon": "case when c_custkey % 13 = 0 then null else cast((c_custkey * 91) % 3600 as double) / 10 - 180 end",
    "date_bp": "case when c_custkey % 17 = 0 then null else cast((c_custkey * 53) % 46000 as double) end",
    "nsnp": "case when c_custkey % 19 = 0 then null else cast((c_custkey * 7919) % 1200000 as bigint) end",
    "assessment": "case c_custkey % 11 when 0 then 'CRITICAL contamination' when 1 then 'QUESTIONABLE' when 2 then null else 'PASS' end",
    "data_type": "c_mktsegment",
    "coverage": "c_acctbal",
    "region": "n_regionkey",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, ind, nat, pop, g, ok, lk): dosages; an individual may have several calls at a site."""
    sup = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_nationkey", "n_regionkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return line.join(sup, F.expr("l_suppkey = s_suppkey")).selectExpr("l_partkey as site", "l_suppkey as ind", "n_nationkey as nat", "n_regionkey as pop", f"{_DOSAGE} as g")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, ind, pop, g): one call for each site and individual, the largest."""
    rows = table(spark, sf_dir, "lineitem").count()
    return dealt(genotypes(spark, sf_dir), rows, "site", "ind").groupBy("site", "ind", "pop").agg(F.max("g").alias("g"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, blk, chrom, cm, price): the panel's sites with their block."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as site", "p_size as chrom", "p_partkey * cast(0.01 as double) as cm", "p_retailprice as price")
    return jackknife.assign_blocks(part, "site")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each site with a frequency for each population."""
    freq = frequency.wide(frequency.allele_frequency(genotypes(spark, sf_dir), "site", "pop"), "site", "pop", POPS)
    return sites(spark, sf_dir).join(freq, "site")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample metadata made of customers."""
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return both.selectExpr(*(f"{v} as {k}" for k, v in META.items()))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, alpha, se, n) of customers with at least 3 lineitems and some spread, and their latest order's age.

    Mean and error come from whole numbers of millionths, so they don't depend on the order of the rows: an equal mean is
    the same double, and the mean of equal discounts has no spread.
    """
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", f"{_BP['spark']} as bp")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount")
    per = line.join(orders, F.expr("l_orderkey = o_orderkey")).groupBy(F.col("o_custkey").alias("id"))
    per = per.agg(frequency.exact_mean("l_discount").alias("alpha"), frequency.exact_se("l_discount").alias("se"), F.count(F.lit(1)).alias("n"), F.min("bp").alias("bp"))
    return per.filter("n >= 3 and se > 0")


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).join(estimates(spark, sf_dir), "id")


SQL = {
    "geno": f"geno as (select l_partkey as site, l_suppkey as ind, n_nationkey as nat, n_regionkey as pop, {_DOSAGE} as g from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)",
    "calls": "calls as (select site, ind, pop, max(g) as g from geno group by site, ind, pop)",
    "sites": "sites as (select p_partkey as site, p_size as chrom, p_partkey * cast(0.01 as double) as cm, p_retailprice as price, cast(floor((row_number() over (order by p_partkey) - 1) * 50.0 / count(*) over ()) as bigint) as blk from part)",
    "freq": "freq as (select site, pop, avg(g) / 2 as p, count(g) as n from geno group by site, pop)",
    "wide": "wide as (select s.site, blk, chrom, cm, price, " + ", ".join(f"max(case when pop = {k} then p end) as {v}" for k, v in POPS.items()) + " from sites s join freq f on s.site = f.site group by s.site, blk, chrom, cm, price)",
    "meta": "meta as (select " + ", ".join(f"{v} as {k}" for k, v in META.items()) + " from customer join nation on c_nationkey = n_nationkey)",
    "est": f"""est as (select id, alpha, se, n, bp from (select id, n, bp, cast(s as double) / cast(1000000 * c as double) as alpha,
     case when c > 1 then sqrt(cast(c * q - s * s as double) / cast(c * c * (c - 1) as double)) / 1000000 end as se from (select o_custkey as id, count(*) as n, min({_BP['duck']}) as bp, count(l_discount) as c,
     cast(sum(cast(round(l_discount * 1000000) as bigint)) as hugeint) as s, sum(cast(round(l_discount * 1000000) as hugeint) * cast(round(l_discount * 1000000) as hugeint)) as q from lineitem join orders on l_orderkey = o_orderkey group by o_custkey)) where n >= 3 and se > 0)""",
    "analysis": "analysis as (select m.*, e.alpha, e.se, e.n, e.bp from meta m join est e on m.id = e.id)",
}
NEEDS = {"calls": ["geno"], "freq": ["geno"], "wide": ["geno", "freq", "sites"], "analysis": ["meta", "est"]}


def ctes(*names: str) -> str:
    """WITH clause of the named views and of what they need."""
    order: list[str] = []
    for n in names:
        for k in [*NEEDS.get(n, []), n]:
            if k not in order:
                order.append(k)
    return "with " + ", ".join(SQL[k] for k in order)


def jackknife_sql(source: str, keys: list[str], stats: dict[str, tuple[str, str]]) -> str:
    """CTEs (to follow others) that end in jk: keys with theta_, se_, z_, sites_ and blocks_ of each statistic."""
    k = "".join(f"{x}, " for x in keys)
    over = f"partition by {', '.join(keys)}" if keys else ""
    sums, totals, loos, ends = [], [], [], []
    for s, (num, den) in stats.items():
        both = f"({num}) is not null and ({den}) is not null"
        sums.append(f"sum(case when {both} then {num} end) as n_{s}, sum(case when {both} then {den} end) as d_{s}, count(case when {both} then 1 end) as c_{s}")
        totals.append(f"sum(n_{s}) over ({over}) as tn_{s}, sum(d_{s}) over ({over}) as td_{s}, sum(c_{s}) over ({over}) as tc_{s}")
        loos.append(f"tn_{s} / nullif(td_{s}, 0) as theta_{s}, tc_{s}, case when c_{s} > 0 then (tn_{s} - n_{s}) / nullif(td_{s} - d_{s}, 0) end as loo_{s}")
        ends.append(f"max(theta_{s}) as theta_{s}, case when count(loo_{s}) > 1 then sqrt((count(loo_{s}) - 1) * var_pop(loo_{s})) end as se_{s}, cast(max(tc_{s}) as bigint) as sites_{s}, count(loo_{s}) as blocks_{s}")
    group = f" group by {', '.join(keys)}" if keys else ""
    return (
        f"b as (select {k}blk, {', '.join(sums)} from {source} group by {k}blk), t as (select *, {', '.join(totals)} from b), "
        f"l as (select {k}{', '.join(loos)} from t), j as (select {k}{', '.join(ends)} from l{group}), "
        f"jk as (select *, {', '.join(f'theta_{s} / nullif(se_{s}, 0) as z_{s}' for s in stats)} from j)"
    )


def two_sided_p_sql(z: str) -> str:
    """Two-sided tail of the normal distribution as a continued fraction, exact enough from |z| of 1.5 on."""
    return f"(2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) / list_reduce(list_prepend(cast({z} as double), range(80, 0, -1)), lambda a, i: ({z}) + i / a))"


def two_sided_p_series_sql(z: str) -> str:
    """The same tail, of |z|, as 1 less the series about 0: good to some 15 decimal places."""
    a = f"least({z}, 8.0)"
    return f"(1 - 2 * exp(-{a} * {a} / 2) / sqrt(2 * pi()) * {a} * list_reduce(list_prepend(cast(1 as double), range(150, 0, -1)), lambda s, i: 1 + s * {a} * {a} / (2 * i + 1)))"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """df with its doubles rounded (special: digits of single columns)."""
    return df.select(*(F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
