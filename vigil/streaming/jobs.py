"""Streams set up from sources to sinks. Backpressure comes from the sources' limits per trigger, order and commits from the
checkpoint, exactly-once results from sinks that may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.model import PAYMENT_EVENT, Thresholds
from vigil.operators import delivery, detect, validate
from vigil.operators.idindex import IdIndex
from vigil.operators.lateness import LambdaViews, event_log
from vigil.sources.sinks import absent_rows_sink, split_sink
from vigil.streaming.detection import ROCKSDB, dedup_stream, judge_stream


def prepare(spark: SparkSession) -> None:
    """Settings that stateful streams need: the RocksDB store, and no empty batches, which availableNow would repeat."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def insert_once(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, cadence: str | None = None) -> StreamingQuery:
    """Append rows of new keys to the table at path. Without a cadence what is there is processed, and the stream ends."""
    writer = stream.writeStream.foreachBatch(absent_rows_sink(path, key, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=cadence) if cadence else writer.trigger(availableNow=True)).start()


def route(stream: DataFrame, ok: str, path: str, rejected: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Valid rows to an insert-if-absent table, all others to dead letters."""
    sink = split_sink(absent_rows_sink(path, key, order), rejected, ok)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detection_jobs(stream: DataFrame, t: Thresholds, outbox: str, letters: str, topic: str, checkpoints: str, cadence: str | None = None) -> list[StreamingQuery]:
    """From a topic's records (key, value, timestamp, headers) to alerts in the outbox's table, and what cannot be read or is
    invalid to dead letters as it came. Tombstones are passed over.

    Two queries on the one source, each with its checkpoint. Copies are blocked, events judged in keyed state, and an alert is
    inserted once by its deterministic id, so that a repeated micro-batch changes nothing.
    """
    raw = stream.select("key", F.col("value").cast("string").alias("value"), "timestamp", "headers")
    read = validate.decode(raw, "value", PAYMENT_EVENT)
    r = lambda name: F.col(f"record.{name}")
    faults = validate.event_violations(r("eventId"), r("accountId"), r("amount"), r("lat"), r("lon"), r("timestamp"))
    judged = read.withColumn("fault", F.when(F.col("poison"), "undecodable").when(faults > 0, "invalid"))
    valid = judged.filter(F.col("fault").isNull()).select(
        r("eventId").alias("event_id"), r("accountId").alias("account_id"), *[r(c).cast("double").alias(c) for c in ("amount", "lat", "lon")],
        F.unix_millis("timestamp").alias("ms"), F.unix_micros(r("timestamp")).alias("produced_us"),
    )
    fresh = dedup_stream(valid, t.dedup_ttl_ms).filter("accepted").drop("accepted")
    alerts = detect.outbox_rows(detect.alerts(judge_stream(fresh, t), t), F.current_timestamp())
    bad = delivery.dead_letters(judged.filter(F.col("fault").isNotNull()).select("key", "value", "headers", "fault"), F.lit(topic))
    timed = lambda writer: writer.trigger(processingTime=cadence) if cadence else writer.trigger(availableNow=True)
    good = alerts.writeStream.foreachBatch(absent_rows_sink(outbox, "id", "payload")).option("checkpointLocation", f"{checkpoints}/alerts")
    rejected = bad.writeStream.format("parquet").option("path", letters).option("checkpointLocation", f"{checkpoints}/letters")
    return [timed(good).start(), timed(rejected).start()]


def hourly_views(stream: DataFrame, views: LambdaViews, name: str, event_time: str, arrival: str, every: int, checkpoint: str) -> StreamingQuery:
    """Lambda views over a stream: each micro-batch goes through the fast layer, every `every`-th is followed by a recompute.

    A micro-batch that is repeated after a restart is logged once; the checkpoint and the views' path belong together."""

    def write(batch: DataFrame, number: int) -> None:
        views.add(event_log(batch, name, event_time, arrival), number)
        if (number + 1) % every == 0:
            views.recompute()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit_stream(stream: DataFrame, index: IdIndex, checkpoint: str) -> StreamingQuery:
    """Admit the identifiers of a stream of (ns, id, row) to the index; repeated micro-batches are admitted once."""

    def write(batch: DataFrame, number: int) -> None:
        index.admit(batch.filter(F.col("id").isNotNull()).select("ns", "id", "row"), number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
