"""Per-sample statistics over files that arrive in a folder: each run works off what is new and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Runs work over the parquet files of source that no earlier run has seen and appends the result to target.

    The checkpoint remembers the files, so a stopped run goes on where it was; each batch is written under its number,
    so a batch that is run again replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
