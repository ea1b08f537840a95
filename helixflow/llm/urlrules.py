"""URL filters by association rules.

Labelled URLs become transactions of tokens (host suffixes, labels of the host, words of the path, keys of the query)
and of their class. Spark's FP-growth mines frequent combinations; rules "tokens -> block" are kept that reach the
least support (a share of the labelled URLs, and MIN_COUNT of them) and confidence and that no rule of fewer tokens with at least the same confidence makes needless. Rules
are filed in an inverted index under their rarest token, joined to the tokens of the distinct URLs, and match where
all their tokens are there. Fixed rules (host, path prefix) go before mined ones; the longest that fits wins.

Defined results: a null URL, or one without "://", has empty host and path, no tokens, no rule, and is allowed.
Without labels or frequent combinations there are no mined rules. Repeated rows get the same verdict.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path prefix): fixed values of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The class item; tokens never hold a space.
BLOCK = "class block"
MIN_SUPPORT = 0.002
MIN_COUNT = 5
#: Of the lower Wilson bound of a rule's confidence, so that a rule seen a few times must be all but certain.
MIN_CONFIDENCE = 0.5
Z = 2.58


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host suffixes, words of the path and keys of the query, each with its place."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    suffix = F.transform(labels, lambda x, i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    words = F.filter(F.split(path(url), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))
    scheme = F.filter(F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)), lambda x: x != "")
    every = F.concat(suffix, F.transform(words, lambda x: F.concat(F.lit("p:"), _lower(x))), F.transform(keys, lambda x: F.concat(F.lit("q:"), x)), F.transform(scheme, lambda x: F.concat(F.lit("s:"), _lower(x))))
    return F.array_distinct(F.transform(every, lambda x: F.regexp_replace(x, r"\s", "_")))


def mine(labelled: DataFrame, url_col: str, blocked: Column, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, confidence, support) of rules "tokens -> block" from labelled rows; blocked: their class.

    Tokens that reach the support in no class cannot stand in a rule and are dropped before mining.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(url_col).isNotNull() & blocked.isNotNull()).select(tokens(F.col(url_col)).alias("items"), blocked.alias("bad"))
    rows = materialize(rows, "transactions")
    n = rows.count()
    least = max(min_support, MIN_COUNT / max(n, 1))
    empty = spark.createDataFrame([], "rule_id bigint, tokens array<string>, confidence double, support double")
    if not n:
        return empty
    # a token must reach the support together with the class
    seen = rows.filter("bad").select(F.explode("items").alias("t")).groupBy("t").count().filter(F.col("count") >= least * n)
    useful = [r["t"] for r in seen.select("t").orderBy(F.col("count").desc(), "t").collect()]  # at most a URL's tokens / least
    if not useful:
        return empty
    items = F.array_intersect("items", F.array(*[F.lit(t) for t in useful]))
    items = F.when(F.col("bad"), F.concat(items, F.array(F.lit(BLOCK)))).otherwise(items)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least), minConfidence=min_confidence).fit(rows.select(items.alias("items")))
    rules = model.associationRules.filter(F.col("consequent")[0] == BLOCK)
    c, m = F.col("confidence"), F.col("support") * n / F.col("confidence")
    sure = (c + Z * Z / (2 * m) - Z * F.sqrt((c * (1 - c) + Z * Z / (4 * m)) / m)) / (1 + Z * Z / m)
    rules = rules.filter(sure >= min_confidence)
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    # needless: a rule of fewer tokens, all of them in this one, is as sure
    short = rules.select(F.col("tokens").alias("t2"), F.col("confidence").alias("c2"), F.element_at("tokens", 1).alias("t"))
    worse = rules.withColumn("t", F.explode("tokens")).join(short, "t").filter((F.size("t2") < F.size("tokens")) & (F.col("c2") >= F.col("confidence")) & (F.size(F.array_except("t2", "tokens")) == 0)).select("tokens").distinct()
    kept = rules.join(worse, "tokens", "left_anti")
    return materialize(kept.withColumn("rule_id", F.xxhash64("tokens")), "kept_rules")


def matched(urls: DataFrame, url_col: str, rules: DataFrame) -> DataFrame:
    """(url, rule_id, confidence): for each distinct URL that a rule matches, the surest (then smallest) rule."""
    per_token = rules.select("rule_id", F.explode("tokens").alias("t"))
    found = urls.select(F.col(url_col).alias("url")).filter("url is not null").distinct().select("url", tokens(F.col("url")).alias("ts"))
    rarity = per_token.groupBy("t").count()
    first = Window.partitionBy("rule_id").orderBy("count", F.length("t").desc(), "t")
    index = per_token.join(rarity, "t").withColumn("r", F.row_number().over(first)).filter("r = 1").select("rule_id", "t")
    index = index.join(rules, "rule_id")
    hits = found.select("url", "ts", F.explode("ts").alias("t")).join(index, "t").filter(F.size(F.array_except("tokens", "ts")) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", F.negative(F.size("tokens")).alias("n"), "rule_id")).alias("b"))
    return best.select("url", "b.rule_id", "b.confidence")


def fixed_rule(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits (its host or a subdomain, its path prefix), else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(ordered):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, mined: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict, mined_rule (its id, null if none) and mined_confidence."""
    out = pages.drop("host", "path", "rule", "verdict", "mined_rule", "mined_confidence")
    best = matched(pages, url_col, mined).select(F.col("url").alias("__url"), F.col("rule_id").alias("mined_rule"), F.col("confidence").alias("mined_confidence"))
    out = out.join(best, F.col(url_col) == F.col("__url"), "left").drop("__url")
    out = out.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col)))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).withColumn("rule", rule)
