"""Folders of files as streams or tables, and jdbc tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def folder_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_trigger).load(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text in `value`, for decode(): a line that is no JSON stays as it is."""
    return spark.read.text(path)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int = 32, **options: str) -> DataFrame:
    """A jdbc table read in parallel by ranges of a numeric key. The driver's jar comes with spark-submit."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
    return reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts).options(**options).load()
