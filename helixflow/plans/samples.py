"""Metadata QC, classification, weighted aggregates and survey queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reports
from ..operators import aggregates as agg
from ..operators import loci, qc
from ..session import ratio
from .genetics import query as _query
from .views import analysis, ctes, estimates, genotypes, meta, rounded, table, two_sided_p_series_sql, two_sided_p_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col


def query(sql: str | None = None):
    return _query(sql, QUERIES, ORACLES)


def _like(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_LOW = "lower(coalesce(country, ''))"
_CONTINENT = f"""case when {_like(_LOW, qc.OCEANIA)} then 'Oceania' when {_like(_LOW, qc.AMERICAS)} then 'Americas' when {_like(_LOW, qc.AFRICA)} then 'Africa'
 when lat is not null and lon is not null then (case when lon <= -28 then 'Americas' when lat <= -10 and lon >= 100 then 'Oceania' else 'Eurasia' end) when coalesce(country, '') <> '' then 'Eurasia' else 'Unknown' end"""
_CLASSED = ctes("meta") + f", geno_ids as (select distinct o_custkey as id from orders), cls as (select m.*, {_CONTINENT} as continent, coalesce(date_bp < 50, ends_with(genetic_id, '.HO')) as is_modern, g.id is not null as genotyped, lower(coalesce(assessment, '')) as al from meta m left join geno_ids g on m.id = g.id)"
_GATE = f"""case when not genotyped then 'not_in_geno' when {_like("lower(group_id)", qc.NOT_TESTED)} then 'reference_or_archaic' when is_modern then 'present_day' when continent <> 'Eurasia' then 'non_eurasian:' || continent
 when contains(al, 'critical') or contains(al, 'fail') then 'qc_assessment:' || substring(trim(assessment), 1, 20) when nsnp is null or nsnp < 30000 then 'low_snps:' || coalesce(cast(nsnp as varchar), '') end"""
_FLAGS = "array_to_string(list_filter([case when nsnp < 200000 then 'low_power' end, case when contains(al, 'questionable') then 'questionable' end, case when date_bp is null then 'no_date' end, case when lat is null or lon is null then 'no_coords' end], lambda x: x is not null), ';')"
_GATED = _CLASSED + f", gated as (select *, {_GATE} as reason, {_FLAGS} as flags from cls)"


def _gated(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(C("o_custkey").alias("gid")).distinct()
    m = meta(spark, d).join(ids, C("id") == C("gid"), "left").withColumn("genotyped", C("gid").isNotNull()).drop("gid")
    m = m.withColumn("continent", qc.continent(C("country"), C("lat"), C("lon"))).withColumn("is_modern", qc.is_modern(C("genetic_id"), C("date_bp")))
    m = m.withColumn("reason", qc.gate(C("genotyped"), C("group_id"), C("is_modern"), C("continent"), C("assessment"), C("nsnp"), 30000))
    low = F.lower(F.coalesce("assessment", F.lit("")))
    flags = qc.flags([(C("nsnp") < 200000, "low_power"), (low.contains("questionable"), "questionable"), (C("date_bp").isNull(), "no_date"), (C("lat").isNull() | C("lon").isNull(), "no_coords")])
    return m.withColumn("flags", F.array_join(flags, ";"))


@query(_GATED + " select id, genetic_id, continent, is_modern, reason, case when reason is null then flags end as flags from gated")
def qc_gates(spark: SparkSession, d: str) -> DataFrame:
    g = _gated(spark, d)
    return g.select("id", "genetic_id", "continent", "is_modern", "reason", F.when(C("reason").isNull(), C("flags")).alias("flags"))


@query(_GATED + " select regexp_replace(coalesce(reason, 'retained'), ':.*$', '') as reason, count(*) as n from gated group by 1")
def qc_summary(spark: SparkSession, d: str) -> DataFrame:
    g = _gated(spark, d).withColumn("reason", F.regexp_replace(F.coalesce("reason", F.lit("retained")), ":.*$", ""))
    return g.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(_GATED + ", x as (select unnest(string_split(flags, ';')) as flag from gated where reason is null) select flag, count(*) as n from x where flag <> '' group by flag")
def flag_explode(spark: SparkSession, d: str) -> DataFrame:
    g = _gated(spark, d).filter(C("reason").isNull())
    return g.select(F.explode(F.split("flags", ";")).alias("flag")).filter("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(_CLASSED + " select id, continent, case when continent = 'Eurasia' and not is_modern then 'eurasia' else 'global' end as scope from cls")
def continent(spark: SparkSession, d: str) -> DataFrame:
    m = meta(spark, d).withColumn("continent", qc.continent(C("country"), C("lat"), C("lon")))
    scope = F.when((C("continent") == "Eurasia") & ~qc.is_modern(C("genetic_id"), C("date_bp")), "eurasia").otherwise("global")
    return m.select("id", "continent", scope.alias("scope"))


_REGION = """case when lat is null or lon is null then 'Unknown' when lon >= 95 and lat < 12 then 'Island SE Asia / Oceania' when lat < 12 and lon between -20 and 52 then 'Africa' when lat >= 55 and lon >= 55 then 'Siberia'
 when lon between -12 and 45 and lat between 36 and 72 then 'Europe' when lon > 45 and lon <= 62 and lat between 33 and 60 then 'Caucasus / W. Central Asia' when lon >= 20 and lon < 63 and lat >= 12 and lat < 42 then 'Near East / Anatolia'
 when lon between 62 and 92 and lat >= 5 and lat < 38 then 'South Asia' when lon >= 62 and lon < 100 and lat >= 38 and lat < 55 then 'Central Asia / Steppe' when lon >= 92 and lat >= 18 and lat < 60 then 'East Asia' else 'Other Eurasia' end"""


@query(ctes("meta") + f" select id, {_REGION} as region from meta")
def macro_region(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d).select("id", qc.macro_region(C("lat"), C("lon")).alias("region"))


@query(ctes("meta") + " select case when date_bp >= 0 and date_bp < 3000 then 0 when date_bp >= 3000 and date_bp < 10000 then 1 when date_bp >= 10000 and date_bp < 40000 then 2 end as bin, count(*) as n from meta group by 1")
def era_bins_half_open(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d).groupBy(qc.half_open(C("date_bp"), [0, 3000, 10000, 40000]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_BINS = (("recent", 0, 2000), ("iron", 2000, 3003), ("bronze", 3003, 5000), ("early", 5000, 12000))


@query(ctes("meta") + ", bins as (select * from (values " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in _BINS) + ") t(name, lo, hi)) select name, count(*) as n, round(avg(date_bp), 6) as mean_bp from meta join bins on date_bp between lo and hi group by name")
def bins_closed(spark: SparkSession, d: str) -> DataFrame:
    """Bins closed at both ends: an age at an edge is in two of them."""
    bins = F.array(*[F.when(C("date_bp").between(a, b), F.lit(n)) for n, a, b in _BINS])
    rows = meta(spark, d).select("date_bp", F.explode(F.array_compact(bins)).alias("name"))
    return rounded(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("date_bp").alias("mean_bp")))


@query(ctes("meta") + " select cast(ceil(date_bp / 2500.0) as bigint) as bin, count(*) as n, round(median(date_bp), 6) as med from meta where date_bp > 0 group by 1")
def bins_right_closed(spark: SparkSession, d: str) -> DataFrame:
    m = meta(spark, d).filter("date_bp > 0")
    return rounded(m.groupBy(qc.right_closed(C("date_bp"), 2500.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.median("date_bp").alias("med")))


_COHORT = "case when contains(lower(group_id), 'etruscan') then 'Etruscan' when starts_with(lower(group_id), 'italy') then 'Italy' when ends_with(group_id, '-o') then 'Outlier' when date_bp < 5000 then 'Young' end"


@query(ctes("meta") + f", l as (select id, {_COHORT} as cohort from meta), r as (select *, row_number() over (partition by cohort order by (id * 7919) % 10007, id) as rn from l where cohort is not null) select id, cohort from r where rn <= 40")
def cohort_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first cohort that fits owns a sample; 40 of each are drawn by a seeded order."""
    from pyspark.sql import Window

    low = F.lower("group_id")
    label = qc.first_of([(low.contains("etruscan"), "Etruscan"), (low.startswith("italy"), "Italy"), (C("group_id").endswith("-o"), "Outlier"), (C("date_bp") < 5000, "Young")])
    draw = Window.partitionBy("cohort").orderBy((C("id") * 7919) % 10007, "id")
    rows = meta(spark, d).select("id", label.alias("cohort")).filter("cohort is not null")
    return rows.withColumn("rn", F.row_number().over(draw)).filter("rn <= 40").select("id", "cohort")


@query(ctes("analysis") + " select id, alpha > 0.05 as high, coalesce(alpha - 1.96 * se > 0.05, false) as sure, nsnp >= 200000 and not contains(coalesce(assessment, ''), 'QUESTIONABLE') as high_conf from analysis")
def survey_masks(spark: SparkSession, d: str) -> DataFrame:
    sure = F.coalesce(C("alpha") - 1.96 * C("se") > 0.05, F.lit(False))
    conf = (C("nsnp") >= 200000) & ~F.coalesce("assessment", F.lit("")).contains("QUESTIONABLE")
    return analysis(spark, d).select("id", (C("alpha") > 0.05).alias("high"), sure.alias("sure"), conf.alias("high_conf"))


@query(ctes("meta") + " select id, genetic_id, date_bp from meta where (regexp_matches(genetic_id, '(?i)#0000001|#0000007') or regexp_matches(group_id, '(?i)IUP|UP|Gravett')) and date_bp >= 25000")
def early_subset(spark: SparkSession, d: str) -> DataFrame:
    named = C("genetic_id").rlike("(?i)#0000001|#0000007") | C("group_id").rlike("(?i)IUP|UP|Gravett")
    return meta(spark, d).filter(named & (C("date_bp") >= 25000)).select("id", "genetic_id", "date_bp")


@query(ctes("meta") + " select id, coalesce(upper(nullif(regexp_extract(genetic_id, '\\.([A-Za-z]+)$', 1), '')), 'NA') as data_type, try_cast(nullif(regexp_extract('[' || cast(coverage as varchar) || ',9]', '\\[([0-9.]+)', 1), '') as double) as lower_bound from meta")
def data_types(spark: SparkSession, d: str) -> DataFrame:
    low = F.nullif(F.regexp_extract(F.concat(F.lit("["), C("coverage").cast("string"), F.lit(",9]")), r"\[([0-9.]+)", 1), F.lit(""))
    return meta(spark, d).select("id", qc.data_type(C("genetic_id")).alias("data_type"), low.try_cast("double").alias("lower_bound"))


_RAW = "case c_custkey % 6 when 0 then '..' when 1 then ' 1,234 ' when 2 then 'n/a' when 3 then '' when 4 then 'x9' else cast(c_custkey as varchar) || '.5' end"


@query(f"select c_custkey as id, case when trim({_RAW}) in ('', '..', '...', 'n/a', 'na', 'NA') then null else try_cast(replace(trim({_RAW}), ',', '') as double) end as value from customer")
def numeric_fields(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(_RAW.replace("varchar", "string"))
    return table(spark, d, "customer").select(C("c_custkey").alias("id"), qc.numeric(raw).alias("value"))


_W = "1 / (greatest(se, 0.0001) * greatest(se, 0.0001))"
_WA = ctes("analysis") + f", w as (select *, {_W} as w from analysis)"


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return analysis(spark, d).withColumn("w", 1 / (F.greatest("se", F.lit(0.0001)) * F.greatest("se", F.lit(0.0001))))


@query(_WA + " select data_type, round(sum(w * alpha) / sum(w), 6) as mean, round(sqrt(1 / sum(w)), 6) as se, count(*) as n from w group by data_type")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_weighted(spark, d).groupBy("data_type").agg(agg.weighted_mean(C("alpha"), C("w")).alias("mean"), F.sqrt(1 / F.sum("w")).alias("se"), F.count(F.lit(1)).alias("n")))


@query(
    _WA
    + """, p as (select region, alpha as x, log10(greatest(coverage, 1)) as y, w from w), m as (select region, sum(w) as sw, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my, count(*) as n from p group by region),
    c as (select p.region, max(n) as n, sum(w * (x - mx) * (y - my)) / max(sw) as cov, sum(w * (x - mx) * (x - mx)) / max(sw) as vx, sum(w * (y - my) * (y - my)) / max(sw) as vy from p join m on p.region = m.region group by p.region)
    select region, round(case when n >= 10 and vx > 0 and vy > 0 then cov / sqrt(vx * vy) end, 4) as r, n from c"""
)
def weighted_corr(spark: SparkSession, d: str) -> DataFrame:
    y = F.log10(F.greatest("coverage", F.lit(1.0)))
    return rounded(_weighted(spark, d).groupBy("region").agg(agg.weighted_corr(C("alpha"), y, C("w")).alias("r"), F.count(F.lit(1)).alias("n")), 4)


@query(_WA + ", m as (select region, sum(w * alpha) / sum(w) as mu from w group by region) select w.region, round(max(mu), 6) as mean, round(sum(w * (alpha - mu) * (alpha - mu)) / sum(w), 6) as var_obs, round(sum(w * se * se) / sum(w), 6) as mean_se2, round(greatest(0, sum(w * (alpha - mu) * (alpha - mu)) / sum(w) - sum(w * se * se) / sum(w)), 6) as var_bio from w join m on w.region = m.region group by w.region")
def variance_decomp(spark: SparkSession, d: str) -> DataFrame:
    a, s, w = C("alpha"), C("se"), C("w")
    return rounded(_weighted(spark, d).groupBy("region").agg(agg.weighted_mean(a, w).alias("mean"), agg.weighted_variance(a, w).alias("var_obs"), agg.weighted_mean(s * s, w).alias("mean_se2"), agg.excess_variance(a, s, w).alias("var_bio")))


@query(_WA + " select region, round(sum(w) * sum(w) / sum(w * w), 4) as n_eff from w group by region")
def effective_n(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_weighted(spark, d).groupBy("region").agg(agg.effective_n(C("w")).alias("n_eff")), 4)


@query(ctes("analysis") + " select region, round(quantile_cont(alpha, 0.05), 6) as q05, round(quantile_cont(alpha, 0.5), 6) as q50, round(quantile_cont(alpha, 0.95), 6) as q95 from analysis group by region")
def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda x: F.percentile("alpha", x)
    return rounded(analysis(spark, d).groupBy("region").agg(q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95")))


@query(ctes("analysis") + " select data_type, region, count(*) as n, round(avg(alpha), 6) as mean, round(median(alpha), 6) as med from analysis group by data_type, region having count(*) >= 5")
def by_type_having(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis(spark, d).groupBy("data_type", "region").agg(F.count(F.lit(1)).alias("n"), F.avg("alpha").alias("mean"), F.median("alpha").alias("med")).filter("n >= 5"))


@query(ctes("analysis") + f", r as (select *, {_REGION} as macro from analysis) select macro, count(*) as n, count(case when alpha > 0.05 then 1 end) as high, count(case when alpha - 1.96 * se > 0.05 then 1 end) as sure, round(avg(case when alpha > 0.05 then 1.0 else 0.0 end), 6) as rate from r group by macro")
def region_breakdown(spark: SparkSession, d: str) -> DataFrame:
    r = analysis(spark, d).withColumn("macro", qc.macro_region(C("lat"), C("lon")))
    high = C("alpha") > 0.05
    return rounded(r.groupBy("macro").agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("high"), F.count_if(C("alpha") - 1.96 * C("se") > 0.05).alias("sure"), F.avg(high.cast("double")).alias("rate")))


@query(ctes("analysis") + " select region, round(corr(alpha, coverage), 6) as r, count(*) as n from analysis where coverage is not null group by region")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis(spark, d).filter("coverage is not null").groupBy("region").agg(F.corr("alpha", "coverage").alias("r"), F.count(F.lit(1)).alias("n")))


@query(ctes("analysis") + ", k as (select rank() over (order by alpha) + (count(*) over (partition by alpha) - 1) / 2.0 as rx, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 as ry from analysis) select round(corr(rx, ry), 6) as rho, count(*) as n from k")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agg.spearman(analysis(spark, d), "alpha", "n"))


@query(ctes("analysis") + " select region, round(regr_slope(alpha, bp), 9) as slope, round(regr_intercept(alpha, bp), 6) as intercept, round(corr(alpha, bp), 6) as r from analysis group by region")
def regression(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis(spark, d).groupBy("region").agg(F.regr_slope("alpha", C("bp").cast("double")).alias("slope"), F.regr_intercept("alpha", C("bp").cast("double")).alias("intercept"), F.corr("alpha", "bp").alias("r")), slope=9)


@query(_WA + ", m as (select sum(w * alpha) / sum(w) as mu from w), z as (select (alpha - mu) / se as z, ends_with(group_id, '-o') as is_o from w cross join m) select is_o, count(*) as n, round(avg(abs(z)), 6) as mean_abs_z, count(case when abs(z) > 2 then 1 end) as above_2 from z group by is_o")
def outlier_class(spark: SparkSession, d: str) -> DataFrame:
    w = _weighted(spark, d)
    mu = F.broadcast(w.agg(agg.weighted_mean(C("alpha"), C("w")).alias("mu")))
    z = w.crossJoin(mu).select(C("group_id").endswith("-o").alias("is_o"), ((C("alpha") - C("mu")) / C("se")).alias("z"))
    return rounded(z.groupBy("is_o").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("z")).alias("mean_abs_z"), F.count_if(F.abs("z") > 2).alias("above_2")))


@query(ctes("analysis") + " select data_type, count(case when alpha >= 0.045 - se and alpha <= 0.055 + se then 1 end) as within_se, count(case when alpha between 0.045 and 0.055 then 1 end) as within_strict, count(*) as n from analysis group by data_type")
def in_range_rate(spark: SparkSession, d: str) -> DataFrame:
    a, s = C("alpha"), C("se")
    return analysis(spark, d).groupBy("data_type").agg(F.count_if((a >= 0.045 - s) & (a <= 0.055 + s)).alias("within_se"), F.count_if(a.between(0.045, 0.055)).alias("within_strict"), F.count(F.lit(1)).alias("n"))


@query(ctes("est") + ", e as (select min(alpha) as lo, max(alpha) as hi, count(*) as total from est), b as (select least(79, cast(floor((alpha - lo) * 80 / nullif(hi - lo, 0)) as bigint)) as bin, count(*) as n, max(lo) as lo, max(hi) as hi, max(total) as total from est cross join e group by 1) select bin, n, round(n * 80 / (total * (hi - lo)), 4) as density from b")
def hist_bins(spark: SparkSession, d: str) -> DataFrame:
    """80 equal bins as densities, for a histogram."""
    e = estimates(spark, d)
    ends = F.broadcast(e.agg(F.min("alpha").alias("lo"), F.max("alpha").alias("hi"), F.count(F.lit(1)).alias("total")))
    b = e.crossJoin(ends).withColumn("bin", F.least(F.lit(79), F.floor((C("alpha") - C("lo")) * 80 / F.nullif(C("hi") - C("lo"), F.lit(0.0)))).cast("bigint"))
    b = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total").alias("total"))
    return rounded(b.select("bin", "n", (C("n") * 80 / (C("total") * (C("hi") - C("lo")))).alias("density")), 4)


@query(ctes("analysis") + " select data_type, round(min(alpha), 6) as low, round(quantile_cont(alpha, 0.25), 6) as q1, round(median(alpha), 6) as med, round(quantile_cont(alpha, 0.75), 6) as q3, round(max(alpha), 6) as high from analysis group by data_type")
def box_data(spark: SparkSession, d: str) -> DataFrame:
    q = lambda x, n: F.percentile("alpha", x).alias(n)
    return rounded(analysis(spark, d).groupBy("data_type").agg(F.min("alpha").alias("low"), q(0.25, "q1"), q(0.5, "med"), q(0.75, "q3"), F.max("alpha").alias("high")))


@query(ctes("analysis") + ", m as (select data_type, region, avg(alpha) as a from analysis where region in (0, 2, 4) group by data_type, region), r as (select *, row_number() over (partition by data_type order by a desc, region) as k from m) select data_type, region, round(a, 6) as mean from r where k = 1")
def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    m = analysis(spark, d).filter(C("region").isin(0, 2, 4)).groupBy("data_type", "region").agg(F.avg("alpha").alias("a"))
    top = m.groupBy("data_type").agg(F.max(F.struct("a", (-C("region")).alias("r"))).alias("t"))
    return rounded(top.select("data_type", (-C("t.r")).cast("int").alias("region"), C("t.a").alias("mean")))


@query(ctes("analysis") + " select round(median(alpha), 6) as baseline, count(*) as n from analysis where region <> 3")
def baseline_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis(spark, d).filter("region <> 3").agg(F.median("alpha").alias("baseline"), F.count(F.lit(1)).alias("n")))


@query(ctes("analysis") + f", z as (select abs((alpha - 0.05) / se) as z, count(*) over () as n from analysis) select count(case when {two_sided_p_sql('z')} < 0.05 / n then 1 end) as significant, round(max(z), 4) as max_abs_z, count(*) as tests from z")
def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """Samples beyond the two-sided threshold of as many tests as there are samples; the SQL compares p values instead."""
    z = analysis(spark, d).select(F.abs((C("alpha") - 0.05) / C("se")).alias("z"))
    return rounded(z.agg(F.count_if(C("z") > agg.bonferroni_z(z.count())).alias("significant"), F.max("z").alias("max_abs_z"), F.count(F.lit(1)).alias("tests")), 4)


@query(ctes("analysis") + f", z as (select id, abs((alpha - 0.05) / se) as z from analysis), p as (select id, {two_sided_p_series_sql('z')} as p from z), r as (select id, p, p * count(*) over () / rank_max as x from (select *, count(*) over (order by p) as rank_max from p)) select id, round(p, 6) as p, round(least(1.0, min(x) over (order by p desc)), 6) as q from r")
def bh_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg adjusted values of two-sided normal p values, beside the Bonferroni counts (an extra)."""
    # Spark may compute z for estimates without spread before it filters them, so these divide to NULL
    p = analysis(spark, d).select("id", agg.two_sided_p(ratio(C("alpha") - 0.05, C("se"))).alias("p"))
    return rounded(agg.benjamini_hochberg(p, "p"))


_HAV = "6371 * 2 * asin(sqrt(pow(sin(radians(lat - 9.0) / 2), 2) + cos(radians(9.0)) * cos(radians(lat)) * pow(sin(radians(lon - 38.7) / 2), 2)))"


@query(ctes("meta") + ", u as (select id, radians(lat) as a, radians(lon) as b, radians(9.0) as p, radians(38.7) as q from meta where lat is not null) select id, round(6371 * 2 * asin(least(1, sqrt(pow(cos(a) * cos(b) - cos(p) * cos(q), 2) + pow(cos(a) * sin(b) - cos(p) * sin(q), 2) + pow(sin(a) - sin(p), 2)) / 2)), 4) as km from u")
def haversine_km(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distance from one place, R = 6371 km; the SQL takes it from the chord between unit vectors."""
    return rounded(meta(spark, d).filter("lat is not null").select("id", F.expr(_HAV).alias("km")), 4)


@query(ctes("meta") + " select id from meta where lon between -11 and 30 and lat between 36 and 71")
def europe_box(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d).filter(C("lon").between(-11, 30) & C("lat").between(36, 71)).select("id")


@query(ctes("geno") + ", a as (select pop, avg(g) as m from geno where site % 2 = 0 group by pop), b as (select pop, avg(g) as m from geno where site % 2 = 1 group by pop) select round(avg(abs(a.m - b.m)), 6) as mean_abs_diff, round(avg(a.m / nullif(b.m, 0)), 6) as mean_ratio, round(corr(a.m, b.m), 6) as r, count(*) as n from a join b on a.pop = b.pop")
def concordance(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two sets of estimates of the same populations."""
    per = genotypes(spark, d).groupBy("pop").agg(F.avg(F.when(loci.thinned(C("site"), 2), C("g"))).alias("a"), F.avg(F.when(~loci.thinned(C("site"), 2), C("g"))).alias("b"))
    per = per.filter("a is not null and b is not null")
    return rounded(per.agg(F.avg(F.abs(C("a") - C("b"))).alias("mean_abs_diff"), F.avg(C("a") / F.nullif(C("b"), F.lit(0.0))).alias("mean_ratio"), F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n")))


_CAND = """select id, (alpha - 0.05) / se as z, nsnp, coalesce(upper(nullif(regexp_extract(genetic_id, '[.]([A-Za-z]+)$', 1), '')), 'NA') as kind, case when id % 8 = 0 then null else concat('[0.0', lpad(cast(id % 40 as {text}), 2, '0'), ',0.2]') end as cont,
 concat(group_id, case region when 0 then '_African' when 2 then '_East' when 4 then '_Levant' else '' end) as grp from analysis"""
_TECH = f"array_to_string(list_filter([case when nsnp < {reports.FEW_SITES} then 'few sites' end, case when kind = 'AG' then 'pseudo-haploid capture' end, case when try_cast(nullif(regexp_extract(cont, '\\[([0-9.]+)', 1), '') as double) > {reports.CONTAMINATION} then 'contamination' end], lambda x: x is not null), ';')"
_BIO = f"array_to_string(list_filter([case when contains(lower(grp), '-o') then 'outlier of its group' end, case when z < 0 and {_like('lower(grp)', reports.LOWER_GROUPS)} then 'admixture with less of it' end, case when z > 0 and {_like('lower(grp)', reports.HIGHER_GROUPS)} then 'ancestry with more of it' end], lambda x: x is not null), ';')"


@query(
    ctes("analysis")
    + f", c as ({_CAND.format(text='varchar')}), e as ((select *, 'high' as side from c order by z desc, id limit 10) union all (select *, 'low' as side from c order by z, id limit 10)) select id, side, round(z, 6) as z, {_TECH} as technical, coalesce(nullif({_BIO}, ''), 'chance, as far as known') as biological from e"
)
def candidate_explanations(spark: SparkSession, d: str) -> DataFrame:
    """The ten highest and ten lowest deviations, with what may explain them."""
    top = reports.extremes(spark.sql(_CAND.format(text="string").replace("from analysis", "from {a}"), a=analysis(spark, d)), "z", "id", 10)
    join = lambda c: F.array_join(c, ";")
    return rounded(top.select("id", "side", "z", join(reports.technical(C("nsnp"), C("kind"), C("cont"))).alias("technical"), join(reports.biological(C("z"), C("grp"))).alias("biological")))
