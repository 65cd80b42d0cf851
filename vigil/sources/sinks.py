"""Sinks for streams: insert-if-absent and dead letters, safe to repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.delivery import insert_if_absent


def absent_rows_sink(path: str, key: str, order: str, parts: int = 256) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds to the parquet table at path the rows whose key is not there yet, one per key.

    The table is laid out by a hash of the key into `part`, and below that by batch. A batch reads the keys of its own parts
    alone, and of other batches only, so that a repeated batch replaces what it had written. Rows with a null key are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.filter(F.col(key).isNotNull()).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("batch", F.lit(number))
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        there = files.exists(root) and any(s.getPath().getName().startswith("part=") for s in files.listStatus(root))
        existing = batch.select(key).limit(0)
        if there:
            own = [r[0] for r in placed.select("part").distinct().collect()]  # at most `parts`
            table = spark.read.schema(f"{key} {dict(batch.dtypes)[key]}, part int, batch bigint").parquet(path)
            existing = table.filter(F.col("part").isin(own) & (F.col("batch") != number))
        new = insert_if_absent(placed, existing, key, order)
        rows = placed.join(new, [key, order], "left_semi").dropDuplicates([key])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)

    return write


def split_sink(good: Callable[[DataFrame, int], None], rejected_path: str, ok: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows with ok true go to `good`, all others to the dead letters below rejected_path."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good(batch.filter(F.col(ok)), number)
            batch.filter(~F.coalesce(F.col(ok), F.lit(False))).write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        finally:
            batch.unpersist()

    return write
