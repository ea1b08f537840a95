"""The corpus pipeline: language ID, near-dedup, decontamination, secret masking and source mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's result to the shared folder and reads it again.

Defined results, in every stage: rows are told apart as rows, so a null or repeated doc_id loses nothing. Null and empty
texts, and texts without a letter, are rejected by the first stage; given to a later one, they pass through it unchanged.
Repeated rows are near duplicates of each other and otherwise judged alike. Texts of any length are read whole. An empty
table gives an empty result. Columns beyond those of documents pass through all stages but the last, also if they have the
name of a column that an operator adds; names that begin with two underscores are the pipeline's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixflow.llm import decontaminate, dedup, langid, mixing, secrets
from helixflow.llm.common import fold_column, materialize, table


def _renamed(docs: DataFrame, added: str) -> DataFrame:
    """docs with the columns that an operator would replace (added: its DDL) under names of the pipeline's own."""
    new = {x.split()[0] for x in added.split(", ")}
    return docs.select(*(F.col(f"`{c}`").alias(f"__{c}") if c in new else F.col(f"`{c}`") for c in docs.columns))


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from what an operator made of _renamed(docs)."""
    there = set(found.columns)
    return found.select(*(F.col(f"`__{c}`").alias(c) if f"__{c}" in there else F.col(f"`{c}`") for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects; the models learn from this stage's own input."""
    model = langid.train(docs, fold_column("doc_id", 5) != 0)
    return _restored(langid.predict(_renamed(docs, langid.RESULT), model).filter(~F.col("rejected")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest doc_id (null last; of rows that share it, the first).

    Rows are told apart by a key of their own, so a null or repeated doc_id links nothing and drops nothing.
    """
    docs = materialize(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")
    groups = dedup.near_duplicates(docs, "__key").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key"))
    kept = docs.select("__key", "doc_id").join(groups, "__key").groupBy("__group").agg(first.alias("first")).select(F.col("first.__key").alias("__key"))
    return docs.join(kept, "__key", "left_semi").drop("__key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontaminate.find_windows(_renamed(docs, "n_words bigint, hits array, items array"), table(spark, sf_dir, "benchmark"))
    return _restored(found.filter(~decontaminate.contaminated()), docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks each secret; documents stay, and so do their lengths."""
    return secrets.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.taken(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("mixture", mixture),
]

#: Language ID, sketches and the decoding worklist cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
