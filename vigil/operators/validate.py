"""Decoding and validation of records; what fails is routed, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.model import SEVERITIES, VERDICT


def decode(df: DataFrame, value: str, schema: str) -> DataFrame:
    """df with `record` (by the schema, unknown fields ignored) and `poison`, true for text that is no JSON object of it.

    Tombstones (null values) are left out. The original value stays in df, so a rejected record can be kept as it came.
    """
    with_corrupt = f"{schema}, __corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    parsed = df.filter(F.col(value).isNotNull()).withColumn("record", F.from_json(F.col(value).cast("string"), with_corrupt, options))
    poison = F.col("record").isNull() | F.col("record.__corrupt").isNotNull() | ~F.trim(F.col(value).cast("string")).startswith("{")
    return parsed.withColumn("poison", F.coalesce(poison, F.lit(True))).withColumn("record", F.col("record").dropFields("__corrupt"))


def event_violations(event_id: Column, account_id: Column, amount: Column, lat: Column, lon: Column, at: Column) -> Column:
    """How many constraints a payment event violates: ids not blank, amount >= 0, lat and lon within their bounds, all set."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    outside = lambda c, lo, hi: c.isNull() | F.isnan(c.cast("double")) | (c < lo) | (c > hi)
    tests = [blank(event_id), blank(account_id), amount.isNull() | F.isnan(amount.cast("double")) | (amount < 0), outside(lat, -90, 90), outside(lon, -180, 180), at.isNull()]
    return sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))


def identity_faults(alert_id: Column, account_id: Column, rule_name: Column) -> Column:
    """Which of the three fields that identify an alert are missing, as text "alert_id,rule_name"; null if none is."""
    named = {"alert_id": alert_id, "account_id": account_id, "rule_name": rule_name}
    missing = F.array_compact(F.array(*[F.when(c.isNull(), name) for name, c in named.items()]))
    return F.nullif(F.array_join(missing, ","), F.lit(""))


def reply_fault(reply: Column) -> Column:
    """What is wrong with a state row array<string> (blocked, prior, n, mean, m2, lat, lon, ms): "shape" if one of the first five
    is missing or no number, "geo" if the place is there in part, no number or out of bounds; null if nothing is. Missing
    elements at the end count as null."""
    at = lambda i: F.try_element_at(reply, F.lit(i + 1))
    whole = lambda i: F.coalesce(at(i).rlike(r"\A-?[0-9]{1,18}\z"), F.lit(False))
    shape = whole(0) & whole(1) & whole(2) & at(3).try_cast("double").isNotNull() & at(4).try_cast("double").isNotNull()
    lat, lon, ms = at(5).try_cast("double"), at(6).try_cast("double"), F.when(whole(7), at(7)).cast("bigint")
    unread = (at(5).isNotNull() & lat.isNull()) | (at(6).isNotNull() & lon.isNull()) | (at(7).isNotNull() & ms.isNull())
    place = unread | location_fault(lat, lon, ms).isNotNull()
    return F.when(~F.coalesce(shape, F.lit(False)), "shape").when(F.coalesce(place, F.lit(False)), "geo")


def split(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which ok is true, and all others (null counts as not ok)."""
    return df.filter(ok), df.filter(~F.coalesce(ok, F.lit(False)))


def location_fault(lat: Column, lon: Column, ms: Column) -> Column:
    """What is wrong with a stored location, first NaN, then partial, then range, then time; null if nothing is."""
    part = lat.isNull() | lon.isNull() | ms.isNull()
    nothing = lat.isNull() & lon.isNull() & ms.isNull()
    out = (F.abs(lat) > 90) | (F.abs(lon) > 180)
    return F.when(nothing, None).when(F.isnan(lat) | F.isnan(lon), "nan").when(part, "partial").when(out, "range").when(ms <= 0, "time")


def verdict_faults(verdict: Column) -> Column:
    """How many constraints a verdict (parsed, see VERDICT) violates; 5 for null."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    confidence, evidence = verdict["confidence"], verdict["evidence"]
    tests = [
        verdict["severity"].isNull() | ~verdict["severity"].isin(*SEVERITIES),
        blank(verdict["narrative"]),
        evidence.isNull(),
        confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1),
        evidence.isNotNull() & F.exists(evidence, lambda e: blank(e["toolCallId"])),
    ]
    return F.when(verdict.isNull(), 5).otherwise(sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0)))


def parse_verdict(text: Column) -> Column:
    """A verdict's JSON text by its schema."""
    return F.from_json(text, VERDICT)
