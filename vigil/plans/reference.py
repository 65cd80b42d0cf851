"""The event-pipeline queries, over `events` and the alert tables.

`events` becomes payment events by fixed synthetic choices: account = user_id, amount = value, and a place derived from the
number k in props (lat = (37 k mod 181) - 90, lon = (61 k mod 361) - 180). The thresholds are set so that rules fire here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ids import canonical_uuid, uuid5
from vigil.functions.text import header_text, is_traceparent, mask
from vigil.model import ALERT_MESSAGE, ALERT_NAMESPACE, MS_PER_HOUR, Thresholds
from vigil.operators import delivery, detect, folds, metrics, triage, validate
from vigil.sources.tables import table

T = Thresholds(velocity_window_ms=6 * MS_PER_HOUR, velocity_max=3, geo_max_kmh=900.0, geo_ttl_ms=24 * MS_PER_HOUR, stats_ttl_ms=24 * MS_PER_HOUR)
NOW_US = 1_592_179_200_000_000  # 2020-06-15 00:00 UTC, the "now" of queries that need one
CAP = 20


def now():
    """The fixed present of the queries."""
    return F.timestamp_micros(F.lit(NOW_US))


def _round(value, digits: int):
    """Rounded with a small bias, so that sums in another order do not fall on the other side of a tie."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-7, digits)


def _unplaced(spark: SparkSession, folder: str) -> DataFrame:
    """events as payment events that have k in place of coordinates."""
    at = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.unix_millis(at).alias("ms"),
        F.unix_micros(at).alias("produced_us"),
    )


def _placed(events: DataFrame) -> DataFrame:
    lat, lon = ((F.col("k") * 37) % 181 - 90).cast("double"), ((F.col("k") * 61) % 361 - 180).cast("double")
    return events.select("event_id", "account_id", "amount", lat.alias("lat"), lon.alias("lon"), "ms", "produced_us")


def payment_events(spark: SparkSession, folder: str) -> DataFrame:
    """events as payment events."""
    return _placed(_unplaced(spark, folder))


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid events. Coordinates made from k are within their bounds whenever there is a k, so that the filter, which
    Spark moves below the projection, tests k alone and the JSON is not read once more for every bound."""
    e = _unplaced(spark, folder)
    faults = validate.event_violations(F.col("event_id"), F.col("account_id"), F.col("amount"), F.lit(0.0), F.lit(0.0), F.col("ms"))
    return _placed(e.filter((faults == 0) & F.col("k").isNotNull()))


def event_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Violations per event; amounts are lowered by 5 so that there are some."""
    e = payment_events(spark, folder).withColumn("amount", F.col("amount") - 5)
    faults = validate.event_violations(F.col("event_id"), F.col("account_id"), F.col("amount"), F.col("lat") * 1.02, F.col("lon"), F.col("ms"))
    return e.select("event_id", faults.cast("bigint").alias("violations"))


def velocity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the account in the window before each event."""
    return detect.velocity(_valid(spark, folder), T.velocity_window_ms).select("event_id", "velocity_prior")


def velocity_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of the velocity rule alone, with their deterministic ids."""
    fired = detect.velocity(_valid(spark, folder), T.velocity_window_ms).filter(detect.velocity_fires(T))
    ident = uuid5(ALERT_NAMESPACE, F.concat_ws(":", "event_id", F.lit("velocity"))).alias("alert_id")
    reason = F.format_string("%d events in window (max=%d)", "velocity_prior", F.lit(T.velocity_max)).alias("reason")
    return fired.select(ident, "event_id", "account_id", F.lit("velocity").alias("rule_name"), reason, "produced_us")


def running_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean and population variance of the account's amounts up to and with each event."""
    s = detect.statistics(_valid(spark, folder))
    return s.select("event_id", "n", _round("mean", 4).alias("mean"), _round(F.col("m2") / F.col("n"), 4).alias("variance"))


def zscore_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Events beyond the z-score threshold."""
    s = folds.capped_welford(detect.fresh(_valid(spark, folder), T), T.zscore_cap)
    z = detect.zscore(F.col("n"), F.col("mean"), F.col("m2"), F.col("amount"), T.zscore_cap)
    return s.filter(detect.zscore_fires(T)).select("event_id", "account_id", "n", _round(z, 4).alias("z"))


def stats_idle_reset(spark: SparkSession, folder: str) -> DataFrame:
    """The same statistics, which start again after a pause longer than the time-to-live."""
    s = detect.statistics(_valid(spark, folder), T.stats_ttl_ms)
    return s.select("event_id", "epoch", "n", _round("mean", 4).alias("mean"), _round(F.col("m2") / F.col("n"), 4).alias("variance"))


def geo_speed(spark: SparkSession, folder: str) -> DataFrame:
    """Distance and speed from the account's event before, unless that has expired."""
    m = detect.movement(_valid(spark, folder), T.geo_ttl_ms)
    return m.select("event_id", F.coalesce("prev.ms", F.lit(0)).alias("prev_ms"), F.round("dist_km", 3).alias("dist_km"), F.round("speed_kmh", 3).alias("speed_kmh"))


def _exempt(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """events with exempt and elevated; every 10th and 7th customer is in the sets."""
    number = F.col("c_custkey")
    of = lambda step: table(spark, folder, "customer").filter(number % step == 0).select(number.cast("string").alias("account_id"))
    return detect.account_flags(events, of(10), of(7))


def account_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Set membership per event, and the rate of its class."""
    e = _exempt(spark, folder, _valid(spark, folder))
    rate = F.when(F.col("elevated"), T.rate_elevated).otherwise(T.rate_default).cast("bigint")
    return e.select("event_id", "exempt", "elevated", rate.alias("rate"))


def geo_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of accounts that are not exempt beyond the speed limit."""
    m = _exempt(spark, folder, detect.movement(_valid(spark, folder), T.geo_ttl_ms))
    return m.filter(detect.geo_fires(T, F.col("exempt"))).select("event_id", "account_id", F.round("speed_kmh", 3).alias("speed_kmh"))


def alerts_all(spark: SparkSession, folder: str) -> DataFrame:
    """At most one alert per event by rule precedence, with statistics that never restart, as in the SQL; see gate_alerts."""
    judged = _exempt(spark, folder, detect.judge(_valid(spark, folder), T, restart=False))
    return detect.alerts(judged, T, F.col("exempt")).drop("reason")


def alert_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts with their texts."""
    judged = _exempt(spark, folder, detect.judge(_valid(spark, folder), T, restart=False))
    return detect.alerts(judged, T, F.col("exempt")).select("event_id", "rule_name", "reason")


def clean_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why each rule did not fire."""
    judged = _exempt(spark, folder, detect.judge(_valid(spark, folder), T, restart=False))
    return judged.select("event_id", *[detect.clean_reason(r, T, F.col("exempt")).alias(r) for r in ("velocity", "zscore", "geo")])


def gate_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of the whole gate over events with copies: copies are blocked, statistics restart after a pause."""
    judged = _exempt(spark, folder, detect.judge(with_copies(_valid(spark, folder)), T))
    return detect.alerts(judged, T, F.col("exempt"))


def masking(spark: SparkSession, folder: str) -> DataFrame:
    """Masked account and event ids."""
    return table(spark, folder, "alert_messages").select("row_id", mask(F.col("account_id"), 4).alias("account"), mask(F.col("event_id"), 8).alias("event"))


def with_copies(e: DataFrame) -> DataFrame:
    """Events with copies: every 10th again after two minutes, every 25th again after ten."""
    n = F.col("event_id").cast("bigint")
    shifted = lambda step, ms, no: e.filter(n % step == 0).withColumn("ms", F.col("ms") + ms).withColumn("arrival", F.lit(no))
    return e.withColumn("arrival", F.lit(0)).unionByName(shifted(10, 120_000, 1)).unionByName(shifted(25, 600_000, 2))


def dedup_ttl(spark: SparkSession, folder: str) -> DataFrame:
    """Which deliveries are accepted when a copy is blocked for five minutes after the accepted one."""
    return folds.dedup_ttl(with_copies(_valid(spark, folder)), T.dedup_ttl_ms).select("event_id", "ms", "accepted")


def welford_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Online statistics that decay beyond CAP events."""
    w = folds.capped_welford(_valid(spark, folder), CAP)
    return w.select("event_id", "n", _round("mean", 4).alias("mean"), _round("m2", 3).alias("m2"))


def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Rate limiting by account with two tokens a second, time running a million times as fast."""
    e = _valid(spark, folder).withColumn("ms", F.floor(F.col("ms") / 86_400)).withColumn("arrival", F.col("event_id").cast("bigint")).withColumn("rate", F.lit(2).cast("bigint"))
    return folds.token_bucket(e, T.bucket_ttl_ms).select("event_id", "allowed", "wait_ms")


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "alert_messages").withColumn("alert", canonical_uuid(F.col("alert_id")))


def _processed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "processed_alerts").withColumn("alert", canonical_uuid(F.col("alert_id")))


def processed_insert(spark: SparkSession, folder: str) -> DataFrame:
    """What inserting alert_messages into processed_alerts would add."""
    there = _processed(spark, folder).filter(F.col("alert").isNotNull())
    return delivery.insert_if_absent(_messages(spark, folder), there.select("alert").distinct(), "alert", "row_id")


def actioned_counts(spark: SparkSession, folder: str) -> DataFrame:
    """actioned and duplicate per rule, a delivery being a duplicate unless it is its alert's first."""
    return metrics.outcome_counts(_messages(spark, folder), "alert", "rule_name", "row_id")


def outbox_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Pending rows, the oldest of them, failed rows."""
    pending = F.col("status") == "PENDING"
    oldest = F.unix_micros(F.min(F.when(pending, F.col("created_at")))).alias("oldest_us")
    return table(spark, folder, "outbox").agg(F.count_if(pending).alias("pending"), oldest, F.count_if(F.col("status") == "FAILED").alias("failed"))


def outbox_purge(spark: SparkSession, folder: str) -> DataFrame:
    """The outbox without published rows older than 7 days."""
    left = delivery.purge(table(spark, folder, "outbox"), F.col("created_at"), now(), 7, F.col("status") == "PUBLISHED")
    return left.select("id", "status", F.unix_micros("created_at").alias("created_us"))


def processed_purge(spark: SparkSession, folder: str) -> DataFrame:
    """Processed alerts without those acted on more than 10 days ago."""
    left = delivery.purge(table(spark, folder, "processed_alerts"), F.col("acted_at"), now(), 10)
    return left.select("row_id", F.coalesce(F.unix_micros("acted_at"), F.lit(0)).alias("acted_us"))


def outbox_next_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 pending rows to publish next."""
    waiting = (F.col("status") == "PENDING") & (F.col("attempts") < delivery.MAX_ATTEMPTS)
    return delivery.next_batch(table(spark, folder, "outbox"), waiting, ["created_at", "id"]).select("id", "attempts")


def outbox_retry(spark: SparkSession, folder: str) -> DataFrame:
    """The outbox after a round in which ids that end in 0 to 7 failed."""
    failed = F.right("id", F.lit(1)).isin(*"01234567")
    return delivery.retry_budget(table(spark, folder, "outbox"), failed).select("id", "status", F.col("attempts").cast("bigint").alias("attempts"))


def outbox_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the payload, and whether the trace parent is well formed."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return table(spark, folder, "outbox").select("id", field("eventId").alias("event_id"), field("ruleName").alias("rule_name"), is_traceparent(F.col("traceparent")).alias("traced"))


def payload_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads by the schema of an alert: poison or not, with its time."""
    d = validate.decode(table(spark, folder, "outbox"), "payload", ALERT_MESSAGE)
    return d.select("id", "poison", F.col("record.alertId").alias("alert_id"), F.unix_micros("record.producedAt").alias("produced_us"))


def recent_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 latest processed alerts of each account."""
    top = delivery.latest_per_key(table(spark, folder, "processed_alerts"), "account_id", [F.col("produced_at").desc_nulls_last(), F.col("row_id").asc()])
    return top.select("account_id", F.col("rank").cast("bigint").alias("rank"), "row_id", "rule_name", F.unix_micros("produced_at").alias("produced_us"))


def account_history(spark: SparkSession, folder: str) -> DataFrame:
    """Per account: number of events, mean amount, last place in time, the ids of the 20 latest events."""
    e = _valid(spark, folder)
    totals = e.groupBy("account_id").agg(F.count(F.lit(1)).alias("event_count"), _round(F.avg("amount"), 4).alias("mean_amount"), F.max("ms").alias("last_ms"))
    top = delivery.latest_per_key(e, "account_id", [F.col("ms").desc(), F.col("event_id").desc()])
    ids = top.groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"]), ",").alias("recent"))
    return totals.join(ids, "account_id")


def triage_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per triage status."""
    return metrics.tagged_counts(table(spark, folder, "triaged_alerts"), ["triage_status"])


def verdict_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Faults per verdict."""
    t = table(spark, folder, "triaged_alerts").filter(F.col("verdict").isNotNull())
    return t.select("row_id", validate.verdict_faults(validate.parse_verdict(F.col("verdict"))).cast("bigint").alias("faults"))


def evidence_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence against executed calls; executed are, by choice, the calls whose number is even."""
    t = table(spark, folder, "triaged_alerts").filter(F.col("verdict").isNotNull()).withColumn("v", validate.parse_verdict(F.col("verdict")))
    executed = F.filter(F.transform(F.col("v.evidence"), lambda e: e["toolCallId"]), lambda c: c.rlike("[02468]$"))
    g = triage.ground(t, "v", F.coalesce(executed, F.array().cast("array<string>")))
    return g.select("row_id", F.size("evidence").cast("bigint").alias("kept"), "stripped", "confidence")


def triage_degraded(spark: SparkSession, folder: str) -> DataFrame:
    """Rule-based verdicts for pending alerts."""
    t = table(spark, folder, "triaged_alerts").filter("triage_status = 'PENDING_TRIAGE'")
    return triage.degraded(t, "llm-unavailable").select("row_id", "severity", "narrative", "confidence", "degraded_reason")


def triage_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 oldest alerts pending for more than five minutes, degraded."""
    stale = (F.col("triage_status") == "PENDING_TRIAGE") & (F.col("created_at") < now() - F.expr("INTERVAL 5 MINUTES"))
    batch = delivery.next_batch(table(spark, folder, "triaged_alerts"), stale, ["created_at", "row_id"])
    return triage.degraded(batch, "stale-pending-sweep").select("row_id", "severity", "degraded_reason")


def _headers(*pairs):
    made = [F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value")) for k, v in pairs]
    return F.array(*made)


def redrive_route(spark: SparkSession, folder: str) -> DataFrame:
    """Where dead letters go; topic and attempts are made from partition and offset."""
    topics = F.element_at(F.array(*[F.lit(x) for x in (*delivery.ALLOWED, "payment.other.DLT")]), (F.col("partition_no") + F.col("offset_no") % 2 + 1).cast("int"))
    tries = F.when(F.col("offset_no") % 6 == 5, F.lit("abc")).otherwise((F.col("offset_no") % 6).cast("string"))
    letters = table(spark, folder, "alert_messages").select("row_id", topics.alias("topic"), _headers(("trace", F.lit("t")), ("x-redrive-attempts", tries)).alias("headers"))
    out = delivery.redrive(letters, now())
    return out.select("row_id", "topic", "dest", header_text(F.col("headers"), "x-redrive-attempts").alias("next"))


def redrive_reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of blocked duplicates; headers are made from the row number."""
    n = F.col("row_id") % 3
    bare, lost = _headers(("trace", F.lit("t"))), _headers(("x-redrive-attempts", F.lit("1")))
    full = _headers(("x-redrive-attempts", F.lit("1")), ("x-rpe-outcome", F.lit("ALERT_UNDURABLE")), ("x-rpe-rule", F.lit("velocity")))
    m = table(spark, folder, "alert_messages").select("row_id", "event_id", "account_id", F.when(n == 0, bare).when(n == 1, lost).otherwise(full).alias("headers"))
    return delivery.reconstruct(m).select("row_id", "action", "rule_name", "reason", "alert_id")


def topic_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Records per topic by offsets; a topic is a batch of reading modulo 4."""
    m = table(spark, folder, "alert_messages").withColumn("topic", F.concat(F.lit("t"), F.col("batch_id") % 4))
    return metrics.depth(m, ["topic"])


def consumer_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Lag behind the ends, nine tenths being committed and nothing in partition 2."""
    ends = table(spark, folder, "alert_messages").groupBy("partition_no").agg((F.max("offset_no") + 1).alias("end_offset")).withColumn("topic", F.lit("payment.alerts"))
    committed = ends.filter("partition_no < 2").select("topic", "partition_no", F.floor(F.col("end_offset") * 9 / 10).alias("committed_offset"))
    return metrics.lag(ends, committed, ["topic"])


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the time from event to action, in ms, per rule."""
    ms = F.unix_millis("acted_at") - F.unix_millis("produced_at")
    return metrics.percentiles(table(spark, folder, "processed_alerts"), ["rule_name"], ms)


def offset_change(spark: SparkSession, folder: str) -> DataFrame:
    """Per partition and quarter of an hour the highest offset and its change."""
    return metrics.change_per_window(table(spark, folder, "alert_messages"), "received_at", "offset_no", ["partition_no"], "15 minutes")


QUERIES = {
    f.__name__: f
    for f in (
        velocity_alerts, velocity_counts, event_validation, running_stats, zscore_alerts, stats_idle_reset, geo_speed, account_classes, geo_alerts,
        alerts_all, alert_reasons, clean_reasons, gate_alerts, masking, dedup_ttl, welford_capped, token_bucket, processed_insert, actioned_counts, outbox_stats,
        outbox_purge, processed_purge, outbox_next_batch, outbox_retry, outbox_fields, payload_decode, recent_alerts, account_history,
        triage_status_counts, verdict_validation, evidence_grounding, triage_degraded, triage_sweep, redrive_route, redrive_reconstruct, topic_depth,
        consumer_lag, latency_percentiles, offset_change,
    )
}
