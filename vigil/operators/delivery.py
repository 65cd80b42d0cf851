"""Delivery: insert-if-absent, purges, retry budgets, re-drive of dead letters. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.ids import uuid5
from vigil.functions.text import attempts, header_text, with_header, with_header_if, without_headers
from vigil.model import ALERT_NAMESPACE

MAX_ATTEMPTS = 5
HEADERS = "array<struct<key:string,value:binary>>"
REDRIVE_CAP = 3
#: Headers that every re-drive replaces. Fixed values.
REDRIVE_HEADERS = ["x-redrive-attempts", "x-redrive-at", "x-redrive-origin"]
#: Dead-letter topics that may be drained, and where to. Fixed values.
ALLOWED = {"payment.events.DLT": "payment.events", "payment.alerts.DLT": "payment.alerts", "payment.alerts.triage.DLT": "payment.alerts"}


#: What becomes of a record by its fault: action, tries more before it, and the pause between tries in ms. Fixed values.
TERMINAL = {
    "none": ("ack", 0, 0),
    "tombstone": ("ack", 0, 0),
    "undecodable": ("dead-letter", 0, 0),
    "invalid": ("dead-letter", 0, 0),
    "rate-breach": ("dead-letter", 0, 0),
    "contract-violation": ("dead-letter", 0, 0),
    "circuit-open": ("hold", 0, 0),
    "not-durable": ("dead-letter", 0, 0),
    "gate-error": ("dead-letter", 2, 100),
    "listener-error": ("dead-letter", 2, 1000),
}
#: The triage's own dead letters go here, whichever topic they came from. Fixed value.
TRIAGE_DEAD_LETTERS = "payment.alerts.triage.DLT"
UNDURABLE = "ALERT_UNDURABLE"


def terminal_path(df: DataFrame, fault: Column, published: Column) -> DataFrame:
    """df with action (ack, dead-letter, hold), retries, backoff_ms and acked: a dead letter's record is acknowledged only if the
    letter was published, a held record stays open. A null fault is none, an unknown one a listener's error."""
    of = F.coalesce(fault, F.lit("none"))
    of = F.when(of.isin(*TERMINAL), of).otherwise("listener-error")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for name, row in TERMINAL.items() for x in (name, row[i])]), of)
    out = df.withColumn("action", pick(0)).withColumn("retries", pick(1)).withColumn("backoff_ms", pick(2))
    acked = (F.col("action") == "ack") | ((F.col("action") == "dead-letter") & F.coalesce(published, F.lit(False)))
    return out.withColumn("acked", acked)


def outcome_headers(headers: Column, rule: Column, reason: Column) -> Column:
    """The headers with the outcome of an alert that fired but could not be made durable, from which reconstruct() builds it
    anew. Without a rule nothing is stamped."""
    stamped = with_header_if(with_header(with_header(headers, "x-rpe-outcome", F.lit(UNDURABLE)), "x-rpe-rule", rule), "x-rpe-reason", reason)
    return F.when(rule.isNull(), headers).otherwise(stamped)


def dead_letters(rejected: DataFrame, topic: Column, pinned: str | None = None) -> DataFrame:
    """rejected (key, value, headers, ...) with topic and partition of their dead letters: <topic>.DLT or the pinned one, any
    partition (-1). Key, value and headers go as they came."""
    return rejected.withColumn("topic", F.lit(pinned) if pinned else F.concat(topic, F.lit(".DLT"))).withColumn("partition", F.lit(-1))


def insert_rows(incoming: DataFrame, existing: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, order, columns) of what an insert that ignores conflicts would add; ties in order go by the columns."""
    first = F.min(F.struct(order, *columns)).alias("__first")
    new = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(first).join(existing.select(key), key, "left_anti")
    return new.select(key, "__first.*")


def insert_if_absent(incoming: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of what an insert that ignores conflicts would add: per key not yet there its first incoming row.

    Copies are combined to one row per key before they are shuffled. Null keys are never inserted.
    """
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    return first.join(existing.select(key), key, "left_anti")


def purge(df: DataFrame, at: Column, now: Column, days: int, only: Column | None = None) -> DataFrame:
    """df without the rows older than `days` (and, if given, for which `only` holds); null times stay."""
    old = at < now - F.make_dt_interval(F.lit(days))
    return df.filter(~F.coalesce(old if only is None else old & only, F.lit(False)))


def retry_budget(outbox: DataFrame, failed: Column, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """The outbox after a round: each pending row was tried; a failure counts, and `limit` failures end it."""
    tried = (F.col("status") == "PENDING") & (F.col("attempts") < limit)
    n = F.when(tried, F.col("attempts") + 1).otherwise(F.col("attempts"))
    status = F.when(tried & ~failed, "PUBLISHED").when((F.col("status") == "PENDING") & (n >= limit), "FAILED").otherwise(F.col("status"))
    return outbox.withColumns({"status": status, "attempts": n})


def next_batch(df: DataFrame, waiting: Column, order: list[str], size: int = 50) -> DataFrame:
    """The first `size` waiting rows in order: a distributed top-k."""
    return df.filter(waiting).orderBy(*order).limit(size)


def latest_per_key(df: DataFrame, key: str, order: list[Column], k: int = 20) -> DataFrame:
    """Up to k rows per key in order, with `rank`. Tasks keep k rows per key before the shuffle, so hot keys stay small."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def redrive(letters: DataFrame, now: Column | None = None, cap: int = REDRIVE_CAP) -> DataFrame:
    """letters (topic, headers, ...) with dest, attempts and the headers of the next try.

    Back to the source up to the cap, then to <topic>.parked. A topic that is not allowed has a null dest and stays. All
    headers are kept but the three of REDRIVE_HEADERS, which are stamped anew: the next number, `now` (by default the
    clock's) in the session's time zone, which should be UTC, and the topic the letter was drained from.
    """
    now = F.current_timestamp() if now is None else now
    n = attempts(header_text(F.col("headers"), "x-redrive-attempts"))
    source = F.element_at(F.create_map(*[F.lit(x) for pair in ALLOWED.items() for x in pair]), F.col("topic"))
    dest = F.when(source.isNull(), None).when(n >= cap, F.concat("topic", F.lit(".parked"))).otherwise(source)
    stamps = [(n + 1).cast("string"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("topic")]
    headers = without_headers(F.coalesce("headers", F.array().cast(HEADERS)), REDRIVE_HEADERS)
    for name, value in zip(REDRIVE_HEADERS, stamps):
        headers = with_header(headers, name, value)
    return letters.withColumn("attempts", n).withColumn("dest", dest).withColumn("headers", headers)


def reconstruct(blocked: DataFrame) -> DataFrame:
    """blocked duplicates (event_id, account_id, headers) with action and, where an alert is re-emitted, its id, rule, reason.

    Without a re-drive header a duplicate is acknowledged; with one, an undurable alert is rebuilt from its headers under the
    same id, and what cannot be rebuilt goes back to the dead letters.
    """
    header = lambda name: header_text(F.col("headers"), name)
    rule, reason = header("x-rpe-rule"), F.coalesce(header("x-rpe-reason"), F.lit("reconstructed-from-redrive"))
    can = (header("x-rpe-outcome") == UNDURABLE) & rule.isNotNull()
    action = F.when(header("x-redrive-attempts").isNull(), "ack").when(can, "emit").otherwise("dead-letter")
    out = blocked.withColumn("action", action)
    emit = F.col("action") == "emit"
    ident = uuid5(ALERT_NAMESPACE, F.concat_ws(":", "event_id", rule))
    return out.withColumn("rule_name", F.when(emit, rule)).withColumn("reason", F.when(emit, reason)).withColumn("alert_id", F.when(emit, ident))
