"""Queries of the whole flow: from payment events to outbox rows, dead letters, triage and the figures watched meanwhile.

Headers and faults that the tables do not have are made from row numbers, as the docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ids import canonical_uuid
from vigil.functions.text import header_text, instant_text, is_traceparent, plain_number, trace_of, with_trace
from vigil.operators import delivery, detect, folds, metrics, triage, validate
from vigil.plans import reference
from vigil.plans.reference import NOW_US, T, now, with_copies
from vigil.sources.tables import table

HEADERS = delivery.HEADERS


def _traced(events: DataFrame) -> DataFrame:
    """events with headers: a trace parent made from the event id, but for every 4th event."""
    digest = F.md5("event_id")
    parent = F.concat(F.lit("00-"), digest, F.lit("-"), F.substring(digest, 1, 16), F.lit("-01"))
    traced = F.array(F.struct(F.lit("traceparent").alias("key"), F.encode(parent, "UTF-8").alias("value")))
    return events.withColumn("headers", F.when(F.col("event_id").cast("bigint") % 4 != 0, traced).otherwise(F.array().cast(HEADERS)))


def pipeline_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The whole detection: deliveries with copies are validated, throttled by their account's class, freed of copies, judged with
    statistics that are capped and restart after a pause, and the first rule that fires becomes a row of the outbox."""
    events = reference._exempt(spark, folder, _traced(with_copies(reference._valid(spark, folder))))
    rated = events.withColumn("rate", F.when(F.col("elevated"), T.rate_elevated).otherwise(T.rate_default).cast("bigint"))
    passed = folds.throttle(rated, T.bucket_ttl_ms).filter("admitted").drop("admitted", "delay_ms", "rate")
    fired = detect.alerts(detect.judge(passed, T), T, F.col("exempt"), keep=("headers",))
    out = detect.outbox_rows(fired.withColumn("trace", trace_of(F.col("headers"))), now(), F.col("trace"))
    return out.withColumn("created_at", F.unix_micros("created_at")).withColumnRenamed("created_at", "created_us")


def throttled(spark: SparkSession, folder: str) -> DataFrame:
    """Events that wait for a token of their account: two a second, none for every 11th account, time running a million times as fast."""
    rate = F.when(F.col("account_id").cast("bigint") % 11 == 0, 0).otherwise(2).cast("bigint")
    e = reference._valid(spark, folder).withColumn("ms", F.floor(F.col("ms") / 86_400)).withColumn("arrival", F.col("event_id").cast("bigint")).withColumn("rate", rate)
    return folds.throttle(e, T.bucket_ttl_ms).select("event_id", "admitted", "delay_ms")


def identity_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts without one of the fields that identify them, and where their dead letters go."""
    faults = validate.identity_faults(canonical_uuid(F.col("alert_id")), F.col("account_id"), F.col("rule_name"))
    bad = table(spark, folder, "alert_messages").select("row_id", faults.alias("missing")).filter(F.col("missing").isNotNull())
    return delivery.dead_letters(bad, F.lit("payment.alerts"), delivery.TRIAGE_DEAD_LETTERS).select("row_id", "missing", "topic", F.col("partition").cast("bigint").alias("partition"))


def reply_validation(spark: SparkSession, folder: str) -> DataFrame:
    """State rows made from row numbers, of every kind of fault, by what is wrong with them."""
    n = F.col("row_id") % 7
    whole = ["0", "5", "42", "100.5", "250.75", "37.7749", "-122.4194", "1700000000000"]
    swapped = lambda i, v: [F.lit(v) if k == i else F.lit(x) for k, x in enumerate(whole)]
    kinds = [F.array(*map(F.lit, whole)), F.array(*map(F.lit, whole[:5])), F.array(*map(F.lit, whole[:3])), F.array(*swapped(3, "x")), F.array(*map(F.lit, whole[:6])), F.array(*swapped(5, "91.5")), F.array(*swapped(7, "0"))]
    reply = F.element_at(F.array(*kinds), (n + 1).cast("int"))
    return table(spark, folder, "alert_messages").select("row_id", F.coalesce(validate.reply_fault(reply), F.lit("")).alias("fault"))


def terminal_paths(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of records by their fault; faults are made from offsets, every 5th letter cannot be published."""
    names = F.array(*[F.lit(x) for x in [*delivery.TERMINAL, "whatever"]])
    fault = F.element_at(names, (F.col("offset_no") % 11 + 1).cast("int"))
    out = delivery.terminal_path(table(spark, folder, "alert_messages").select("row_id", "offset_no"), fault, F.col("row_id") % 5 != 0)
    return out.select("row_id", "action", F.col("retries").cast("bigint").alias("retries"), F.col("backoff_ms").cast("bigint").alias("backoff_ms"), "acked")


def undurable_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts that could not be made durable: stamped with their outcome, re-driven, and built anew from their headers."""
    m = table(spark, folder, "alert_messages").select("row_id", "event_id", "account_id", F.col("rule_name").alias("rule"), F.col("reason").alias("told"))
    stamped = m.withColumn("headers", delivery.outcome_headers(F.array().cast(HEADERS), F.col("rule"), F.col("told")))
    letters = delivery.redrive(delivery.dead_letters(stamped, F.lit("payment.events")), now())
    back = delivery.reconstruct(letters.withColumn("origin", header_text(F.col("headers"), "x-redrive-origin")).withColumn("redriven_at", header_text(F.col("headers"), "x-redrive-at")))
    return back.select("row_id", "dest", "origin", "redriven_at", "action", "alert_id", "reason", F.size("headers").cast("bigint").alias("n_headers"))


def trace_publish(spark: SparkSession, folder: str) -> DataFrame:
    """With which trace the outbox's rows are published: the stored one, or a new one."""
    headers = with_trace(F.array().cast(HEADERS), F.col("traceparent"), F.col("tracestate"))
    rows = table(spark, folder, "outbox").select("id", trace_of(headers).alias("trace"))
    return rows.select("id", F.substring("trace.traceparent", 4, 32).alias("trace_id"), F.col("trace.tracestate").alias("tracestate"), is_traceparent(F.col("trace.traceparent")).alias("goes_on"))


def plain_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts as plain digits; divided, so that some are small."""
    return table(spark, folder, "events").select("event_id", plain_number(F.col("value") / 1024 / 1024, 38, 9).alias("digits"))


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "alert_messages").withColumn("alert", canonical_uuid(F.col("alert_id")))


def triage_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that taking in alert_messages adds to the triage's inbox, before anything is done about them."""
    whole = F.col("account_id").isNotNull() & F.col("rule_name").isNotNull()
    there = table(spark, folder, "triaged_alerts").select(canonical_uuid(F.col("alert_id")).alias("alert")).filter(F.col("alert").isNotNull()).distinct()
    new = delivery.insert_rows(_alerts(spark, folder).filter(whole), there, "alert", "row_id", ["account_id", "rule_name"])
    return new.withColumn("triage_status", F.lit(triage.PENDING))


def triage_marks(spark: SparkSession, folder: str) -> DataFrame:
    """The inbox after verdicts on every second row; those that find their row no longer pending are lost."""
    inbox = table(spark, folder, "triaged_alerts").select("row_id", "triage_status")
    verdicts = inbox.filter(F.col("row_id") % 2 == 0).select("row_id", F.lit(triage.DEGRADED).alias("new_status"))
    return triage.mark(inbox, verdicts, "row_id").select("row_id", "triage_status", F.coalesce("mark", F.lit("")).alias("mark"))


def triage_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of rule-based verdicts on pending rows."""
    pending = table(spark, folder, "triaged_alerts").filter(F.col("triage_status") == triage.PENDING)
    alerts = pending.select("row_id", canonical_uuid(F.col("alert_id")).alias("alert_id"), F.lit(None).cast("string").alias("event_id"), "account_id", "rule_name")
    return triage.degraded_message(triage.degraded(alerts, "stale-pending-sweep"), F.lit(NOW_US), "triage-v2").select("row_id", "message")


def tool_recent_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The reply on recent alerts for each account that has any."""
    top = delivery.latest_per_key(table(spark, folder, "processed_alerts"), "account_id", [F.col("produced_at").desc_nulls_last(), F.col("row_id").asc()])
    return triage.recent_alerts_reply(top.withColumn("produced_us", F.unix_micros("produced_at")), "account_id", "rank", "rule_name", "produced_us")


def tool_history(spark: SparkSession, folder: str) -> DataFrame:
    """The reply on each account's history, for requests of which every 5th names another account than the alert's own."""
    h = reference.account_history(spark, folder)
    digits = F.round("mean_amount", 4).cast("decimal(18,4)").cast("string")
    told = triage.history_reply(h, F.col("event_count"), digits, F.col("last_ms"), F.split("recent", ","))
    asked = F.when(F.col("account_id").cast("bigint") % 5 == 0, "another").otherwise(F.col("account_id"))
    return told.select("account_id", triage.scoped(asked, F.col("account_id"), F.col("reply")).alias("reply"))


BOUNDS = [1_000.0, 5_000.0, 30_000.0, 60_000.0, 300_000.0, 3_600_000.0]


def _latency_buckets(spark: SparkSession, folder: str) -> DataFrame:
    ms = F.unix_millis("acted_at") - F.unix_millis("produced_at")
    return metrics.histogram(table(spark, folder, "processed_alerts"), ["rule_name"], ms, BOUNDS)


def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Per rule the number of alerts by the time from event to action, in cumulative buckets of ms."""
    return _latency_buckets(spark, folder).select("rule_name", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("bigint").cast("string")).alias("le"), "n")


def latency_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles per rule from the buckets."""
    q = metrics.histogram_quantiles(_latency_buckets(spark, folder), ["rule_name"])
    return q.select("rule_name", *[F.round(F.coalesce(p, F.lit(-1.0)) + 1e-7, 3).alias(p) for p in ("p95", "p99")])


def latency_percentiles_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the time from event to action, in ms, per rule, without approximation."""
    ms = F.unix_millis("acted_at") - F.unix_millis("produced_at")
    return metrics.exact_percentiles(table(spark, folder, "processed_alerts"), ["rule_name"], ms, 3_600_000)


def counter_increase(spark: SparkSession, folder: str) -> DataFrame:
    """Per partition and quarter of an hour the growth of a counter that starts anew every 500 records."""
    m = table(spark, folder, "alert_messages").withColumn("counter", F.col("offset_no") % 500)
    out = metrics.counter_increase(m, "received_at", ["received_at", "offset_no"], "counter", ["partition_no"], "15 minutes")
    return out.select("partition_no", "window_us", "increase", F.round("per_second", 6).alias("per_second"))


def failed_percent(spark: SparkSession, folder: str) -> DataFrame:
    """Per hour the percentage of outbox rows that failed."""
    hour = F.unix_micros(F.date_trunc("hour", "created_at")).alias("hour_us")
    o = table(spark, folder, "outbox").select(hour, "status")
    out = metrics.percent_of(o, ["hour_us"], F.count_if(F.col("status") == "FAILED"), F.count(F.lit(1)))
    return out.select("hour_us", F.round(F.col("percent") + 1e-9, 6).alias("percent"))


def attempts_percent(spark: SparkSession, folder: str) -> DataFrame:
    """Per status the highest number of attempts in percent of the limit."""
    return metrics.percent_of(table(spark, folder, "outbox"), ["status"], F.max("attempts"), F.lit(delivery.MAX_ATTEMPTS))


def depth_alarms(spark: SparkSession, folder: str) -> DataFrame:
    """Topics whose dead letters raise an alarm: any in a parked topic, any that grow by more than 100 a quarter of an hour in another.
    A topic is a batch of reading modulo 4, the last of which is parked."""
    topic = F.concat(F.lit("t"), F.col("batch_id") % 4, F.when(F.col("batch_id") % 4 == 3, ".parked").otherwise(""))
    m = table(spark, folder, "alert_messages").withColumn("topic", topic)
    grown = metrics.counter_increase(m, "received_at", ["received_at", "offset_no"], "offset_no", ["topic", "partition_no"], "15 minutes")
    most = grown.groupBy("topic", "window_us").agg(F.sum("increase").alias("n")).groupBy("topic").agg(F.max("n").alias("n"))
    parked = F.col("topic").endswith(".parked")
    depth = metrics.depth(m, ["topic"]).filter(parked & (F.col("depth") > 0)).select("topic", F.lit("parked").alias("alarm"), F.col("depth").alias("n"))
    return depth.unionByName(most.filter(~parked & (F.col("n") > 100)).select("topic", F.lit("growing").alias("alarm"), "n"))


def stored_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times of the outbox as ISO text."""
    return table(spark, folder, "outbox").select("id", instant_text(F.unix_micros("created_at")).alias("created"))


QUERIES = {
    f.__name__: f
    for f in (
        pipeline_alerts, throttled, identity_validation, reply_validation, terminal_paths, undurable_letters, trace_publish, plain_numbers, triage_inbox, triage_marks,
        triage_messages, tool_recent_alerts, tool_history, latency_histogram, latency_quantiles, latency_percentiles_exact, counter_increase, failed_percent, attempts_percent, depth_alarms, stored_times,
    )
}
