from pyspark.sql import functions as F

from helixflow.streaming.arrivals import process_new


def test_only_new_files_are_worked_off(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    work = lambda df: df.groupBy("k").agg(F.sum("v").alias("s"))
    for n in (1, 2):
        spark.createDataFrame([(n, 10 * n)], "k int, v int").coalesce(1).write.mode("append").parquet(src)
        process_new(spark, src, "k int, v int", work, out, state)
    process_new(spark, src, "k int, v int", work, out, state)
    assert sorted((r["k"], r["s"]) for r in spark.read.parquet(out).collect()) == [(1, 10), (2, 20)]
