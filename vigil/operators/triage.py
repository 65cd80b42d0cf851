"""Grounding of verdicts in evidence, and the rule-based verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import instant_text

#: Severity by rule, and the tools a rule may use. Fixed values.
RULE_SEVERITY = {"geo": "HIGH", "velocity": "MEDIUM", "zscore": "MEDIUM"}
RULE_TOOLS = {"geo": ["history"], "velocity": ["history", "recent-alerts"], "zscore": ["history", "recent-alerts"]}


#: Texts and names of the fixed wire format.
ACCOUNT_MISMATCH = '{"error":"account mismatch: tools may only query the alert\'s own account"}'
PENDING, DEGRADED, SCHEMA_VERSION = "PENDING_TRIAGE", "DEGRADED_RULE_BASED", "1"
MESSAGE = (
    "alertId", "eventId", "accountId", "ruleName", "severity", "narrative", "evidence", "confidence", "triageStatus", "promptVersion", "evidenceStripped",
    "toolRounds", "degradedReason", "triagedAt", "schemaVersion",
)


def scoped(requested: Column, expected: Column, reply: Column) -> Column:
    """A tool's reply, or the error if another account than the alert's own was asked for; null asks for no account."""
    return F.when(F.coalesce(requested == expected, F.lit(False)), reply).otherwise(ACCOUNT_MISMATCH)


def recent_alerts_reply(top: DataFrame, account: str, rank: str, rule: str, produced_us: str) -> DataFrame:
    """(account, reply): the latest alerts of each account as JSON, from rows that are ranked and few per account."""
    item = F.struct(F.col(rank).alias("rank"), F.struct(F.col(rule).alias("ruleName"), instant_text(F.col(produced_us)).alias("producedAt")).alias("alert"))
    sorted_items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["alert"])
    return top.groupBy(account).agg(F.to_json(F.struct(sorted_items.alias("recentAlerts")), {"ignoreNullFields": "false"}).alias("reply"))


def history_reply(df: DataFrame, events: Column, mean: Column, last_ms: Column, recent: Column) -> DataFrame:
    """df with reply: an account's statistics, last time and recent event ids as JSON; without events "0", "0", null and none."""
    stats = F.struct(F.coalesce(events.cast("string"), F.lit("0")).alias("eventCount"), F.coalesce(mean, F.lit("0")).alias("meanAmount"))
    ids = F.coalesce(recent, F.array().cast("array<string>"))
    snapshot = F.struct(stats.alias("stats"), last_ms.cast("string").alias("lastLocationTimestampMs"), ids.alias("recentEventIdsInWindow"))
    return df.withColumn("reply", F.to_json(snapshot, {"ignoreNullFields": "false"}))


def mark(inbox: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """inbox (key, triage_status, ...) with the verdicts (key, new_status) that found their row still pending, and `mark`:
    recorded, lost (the row had left its pending state) or null (no verdict). A row leaves PENDING_TRIAGE once."""
    given = verdicts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("new_status").alias("__new"))
    pending, has = F.col("triage_status") == PENDING, F.col("__new").isNotNull()
    marked = inbox.join(given, key, "left").withColumn("mark", F.when(has & pending, "recorded").when(has, "lost"))
    return marked.withColumn("triage_status", F.when(F.col("mark") == "recorded", F.col("__new")).otherwise(F.col("triage_status"))).drop("__new")


def degraded_message(df: DataFrame, now_us: Column, prompt_version: str) -> DataFrame:
    """df (alert_id, event_id, account_id, rule_name, and the columns of degraded()) with message, the verdict's JSON of 15 fields."""
    none = F.array().cast("array<struct<toolCallId:string,finding:string>>")
    values = [
        F.col("alert_id"), F.col("event_id"), F.col("account_id"), F.col("rule_name"), F.col("severity"), F.col("narrative"), none, F.col("confidence"), F.lit(DEGRADED),
        F.lit(prompt_version), F.lit(False), F.lit(0), F.col("degraded_reason"), instant_text(now_us), F.lit(SCHEMA_VERSION),
    ]
    message = F.struct(*[value.alias(name) for name, value in zip(MESSAGE, values)])
    return df.withColumn("message", F.to_json(message, {"ignoreNullFields": "false"}))


def severity_of(rule: Column) -> Column:
    """The rule's severity; MEDIUM for any other rule and for null."""
    known = F.create_map(*[F.lit(x) for pair in RULE_SEVERITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, rule), F.lit("MEDIUM"))


def tools_of(rule: Column) -> Column:
    """The tools that a rule may use."""
    known = F.create_map(*[x for r, tools in RULE_TOOLS.items() for x in (F.lit(r), F.array(*map(F.lit, tools)))])
    return F.coalesce(F.try_element_at(known, rule), F.array(F.lit("history")))


def ground(df: DataFrame, verdict: str, executed: Column) -> DataFrame:
    """df with evidence (the items whose call was executed), stripped (there were items and none is left) and confidence
    (at most 0.2 if stripped)."""
    items = F.coalesce(F.col(f"{verdict}.evidence"), F.array().cast("array<struct<toolCallId:string,finding:string>>"))
    kept = F.filter(items, lambda e: F.array_contains(executed, e["toolCallId"]))
    stripped = (F.size(items) > 0) & (F.size(kept) == 0)
    confidence = F.col(f"{verdict}.confidence")
    return df.withColumn("evidence", kept).withColumn("stripped", stripped).withColumn("confidence", F.when(stripped, F.least(confidence, F.lit(0.2))).otherwise(confidence))


def degraded(df: DataFrame, reason: str) -> DataFrame:
    """df (rule_name, ...) with the rule-based verdict: severity, narrative, confidence 0 and the reason."""
    told = F.format_string("Rule-based severity (LLM triage unavailable): %s alert.", "rule_name")
    return df.withColumn("severity", severity_of(F.col("rule_name"))).withColumn("narrative", told).withColumn("confidence", F.lit(0.0)).withColumn("degraded_reason", F.lit(reason))


def retryable(status: Column, io_error: Column) -> Column:
    """Whether a failed call is tried again: broken connections, 429 and server errors are, other 4xx are not."""
    return F.coalesce(io_error, F.lit(False)) | F.coalesce((status == 429) | (status >= 500), F.lit(False))
