"""Session factory and NULL-aware column helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "helixflow", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf adds or overrides settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0))


def clean(c: Column) -> Column:
    """NaN becomes NULL: missing values never enter a plan as NaN."""
    return F.when(~F.isnan(c), c)


#: Rows of a task of dealt(): aggregates over them hold some 100 MB.
ROWS_A_TASK = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by hash of the keys, in as many partitions as `rows` need for ROWS_A_TASK each, and one a core at least.

    Aggregates by these keys and others then hold no more at any size; adaptive execution alone merges partitions up to a
    size in compressed bytes, which is millions of narrow rows.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """df read back from the reliable checkpoint folder; a local session that names none, as in tests, gets its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixflow-"))
    return df.checkpoint()
