"""Topics as streams or tables. The connector comes with spark-submit --packages; without it these raise Spark's own error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000, committed_only: bool = True, **options: str) -> DataFrame:
    """A topic from its beginning, with headers; at most per_trigger records a micro-batch."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).option("includeHeaders", "true")
    reader = reader.option("kafka.isolation.level", "read_committed" if committed_only else "read_uncommitted")
    return reader.options(**options).load()


def topic_table(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic up to its present end, for draining dead letters."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true")
    return reader.options(**options).load()


def to_topic(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, value) with the fields as a JSON object in value, ready for the Kafka sink."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Write a stream of (key, value) to a topic, at least once."""
    writer = df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).start()
