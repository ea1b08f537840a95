"""The operators of this subpackage as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dedup, hamming, html, langid, lexical, lm, mixing, pstable, quality, repair, secrets, urlrules
from .common import fold_column, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(lm.learn(docs, fold_column("doc_id", 10) != 0))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontaminate.items_sha256().alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of each row whose id is divisible by 50."""
    codes = hamming.codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.top_k(codes, codes.filter(F.pmod("id", F.lit(50)) == 0), 10)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold_column("doc_id", 5) != 0)
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_column("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).drop("html")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _numbered(pages: DataFrame) -> DataFrame:
    """pages with doc_id, the number that the URL's path ends in (null if there is none)."""
    number = F.regexp_extract(urlrules.path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+|/)?$", 1)
    return pages.withColumn("doc_id", F.when(number != "", number).cast("bigint"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and paths (their first part) are those of the document's pages, or else its source and language."""
    first = F.regexp_extract(urlrules.path(F.col("url")), r"^(/[^/]*)", 1)
    sites = _numbered(table(spark, sf_dir, "pages").select("url")).select("doc_id", urlrules.host(F.col("url")).alias("host"), first.alias("path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.judged(docs, table(spark, sf_dir, "labels"), fold_column("doc_id", 5) != 0, host_col="source", path_col="lang", sites=sites)


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url and bad (toxic or of low quality) of the pages whose URL ends in the number of a labelled document."""
    pages = _numbered(table(spark, sf_dir, "pages").select("url"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).alias("bad"))
    return pages.join(labels, "doc_id").select("url", "bad")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = urlrules.mine(labelled_pages(spark, sf_dir), "url", F.col("bad"))
    out = urlrules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), mined)
    return out.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations are damaged first."""
    hurt = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.report(repair.edits(hurt, live=F.col("live")))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pstable.top_k(rows, rows.filter(F.pmod("vec_id", F.lit(20)) == 0))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_near_dedup, op3_mix_sources, op4_decontaminate, op5_exact_topk, op6_language_id, op7_html_text, op8_secret_scan, op9_quality, op10_url_filter, op11_repair, op12_neighbours, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in queries()}
