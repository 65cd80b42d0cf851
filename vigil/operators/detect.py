"""Detection: velocity, z-score and geographic speed rules over payment events.

Payment events have event_id, account_id, amount (double), lat, lon (double), ms (bigint, the record's time) and
produced_us (bigint, the payload's time). The order of an account's events is (ms, event_id). Validate first: ids, ms and
numbers must not be null here. Time-to-live is taken in event time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.geo import haversine_km, speed_kmh
from vigil.functions.ids import uuid5
from vigil.functions.text import instant_text
from vigil.model import ALERT_NAMESPACE, Thresholds
from vigil.operators.folds import capped_welford, dedup_ttl
from vigil.operators.running import BLOCK_MS, prior_in_window, running, statistics
from vigil.session import written

__all__ = ["BLOCK_MS", "account_flags", "alert_reason", "alerts", "clean_reason", "fresh", "geo_fires", "idle_epochs", "judge", "movement", "outbox_rows", "statistics", "velocity", "velocity_fires", "zscore", "zscore_fires"]
#: What the speed rule needs of the event before.
_PLACE = {"prev": ["lat", "lon", "ms"]}


def velocity(events: DataFrame, window_ms: int) -> DataFrame:
    """events with velocity_prior: the account's events less than the window before, each id counted once at a time."""
    return prior_in_window(events, "account_id", "ms", "event_id", window_ms, "velocity_prior")


def idle_epochs(events: DataFrame, ttl_ms: int, block_ms: int = BLOCK_MS) -> DataFrame:
    """events with epoch: how often the account had been idle for longer than the time-to-live, so that statistics restart."""
    kept = [c for c in events.columns if c.lower() != "epoch"]
    return statistics(events, ttl_ms, block_ms).select(*kept, "epoch")


def movement(events: DataFrame, ttl_ms: int, block_ms: int = BLOCK_MS) -> DataFrame:
    """events with prev (lat, lon, ms of the account's event before; null if none or expired), dist_km and speed_kmh."""
    blocked = events.withColumn("__block", F.floor(F.col("ms") / block_ms))
    return _moved(running(blocked, ["account_id"], "__block", ["ms", "event_id"], previous=_PLACE).drop("__block"), ttl_ms)


def _moved(placed: DataFrame, ttl_ms: int) -> DataFrame:
    prev = F.when(F.col("ms") - F.col("prev.ms") <= ttl_ms, F.col("prev"))
    out = placed.withColumn("prev", prev)
    out = out.withColumn("dist_km", haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")))
    return out.withColumn("speed_kmh", speed_kmh(F.col("dist_km"), F.col("ms") - F.col("prev.ms")))


def zscore(n: Column, mean: Column, m2: Column, x: Column, cap: int) -> Column:
    """|x - mean| over the population standard deviation with divisor min(n, cap); null where that deviation is 0.

    mean and m2 must be those of capped_welford with the same cap.
    """
    deviation = F.sqrt(m2 / F.least(n, F.lit(cap)))
    return F.when(deviation > 0, F.abs(x - mean) / deviation)


def velocity_fires(t: Thresholds) -> Column:
    """Whether the velocity rule fires."""
    return F.col("velocity_prior") >= t.velocity_max


def zscore_fires(t: Thresholds) -> Column:
    """Whether the z-score rule fires: enough events, a deviation, and strictly beyond the threshold."""
    z = zscore(F.col("n"), F.col("mean"), F.col("m2"), F.col("amount"), t.zscore_cap)
    return (F.col("n") >= t.zscore_min_count) & (F.coalesce(z, F.lit(0.0)) > t.zscore_threshold)


def geo_fires(t: Thresholds, exempt: Column | None = None) -> Column:
    """Whether the speed rule fires: not exempt, a previous place, time passed, strictly beyond the threshold."""
    fires = F.coalesce(F.col("speed_kmh") > t.geo_max_kmh, F.lit(False))
    return fires if exempt is None else fires & ~exempt


def clean_reason(rule: str, t: Thresholds, exempt: Column | None = None) -> Column:
    """Why a rule did not fire; null where it did."""
    if rule == "velocity":
        return F.when(~velocity_fires(t), "velocity:ok")
    if rule == "zscore":
        short, flat = F.col("n") < t.zscore_min_count, F.col("m2") == 0
        return F.when(short, "zscore:insufficient-history").when(flat, "zscore:stddev=0,all-amounts-identical").when(~zscore_fires(t), "zscore:ok")
    spared = F.lit(False) if exempt is None else exempt
    return (
        F.when(spared, "geo:exempt")
        .when(F.col("prev").isNull(), "geo:no-prior-location")
        .when(F.col("ms") - F.col("prev.ms") <= 0, "geo:non-positive-time-delta")
        .when(~geo_fires(t), "geo:ok")
    )


def alert_reason(t: Thresholds) -> Column:
    """The text of an alert by its rule_name; numbers are formatted as in the fixed patterns."""
    z = zscore(F.col("n"), F.col("mean"), F.col("m2"), F.col("amount"), t.zscore_cap)
    text = {
        "velocity": F.format_string("%d events in window (max=%d)", "velocity_prior", F.lit(t.velocity_max)),
        "zscore": F.format_string("z=%.2f > threshold=%.1f", z, F.lit(t.zscore_threshold)),
        "geo": F.format_string("speed=%.1f km/h > max=%.1f km/h (dist=%.1f km, delta=%d ms)", "speed_kmh", F.lit(t.geo_max_kmh), "dist_km", F.col("ms") - F.col("prev.ms")),
    }
    out = F.lit(None).cast("string")
    for rule, reason in text.items():
        out = F.when(F.col("rule_name") == rule, reason).otherwise(out)
    return out


def alerts(judged: DataFrame, t: Thresholds, exempt: Column | None = None, more: list[tuple[str, Column, Column]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """At most one alert per event, of the first rule that fires (velocity, z-score, geo), under a deterministic id.

    `more` adds rules after these: (name, whether it fires, reason), as pure expressions over the columns of judged. Columns in
    `keep` go with the alert.
    """
    own = [("velocity", velocity_fires(t)), ("zscore", zscore_fires(t)), ("geo", geo_fires(t, exempt))]
    rule, reason = F.lit(None).cast("string"), alert_reason(t)
    for name, fires, *told in reversed([*own, *(more or [])]):
        rule = F.when(fires, name).otherwise(rule)
        if told:
            reason = F.when(F.col("rule_name") == name, told[0]).otherwise(reason)
    fired = judged.withColumn("rule_name", rule).filter(F.col("rule_name").isNotNull())
    ident = uuid5(ALERT_NAMESPACE, F.concat_ws(":", "event_id", "rule_name"))
    return fired.select(ident.alias("alert_id"), "event_id", "account_id", "rule_name", reason.alias("reason"), "produced_us", *keep)


def account_flags(events: DataFrame, exempt: DataFrame, elevated: DataFrame) -> DataFrame:
    """events with exempt and elevated, whether the account is in the sets (tables with account_id). An account in no set, as one
    whose lookup failed, is neither. The sets are combined to one dimension, which joins may broadcast as far as its size
    allows; a stream takes them up anew by reading them in every micro-batch."""
    rows = exempt.select("account_id", F.lit(True).alias("__x"), F.lit(False).alias("__l")).unionByName(elevated.select("account_id", F.lit(False).alias("__x"), F.lit(True).alias("__l")))
    member = rows.filter(F.col("account_id").isNotNull()).groupBy("account_id").agg(F.bool_or("__x").alias("exempt"), F.bool_or("__l").alias("elevated"))
    joined = events.drop("exempt", "elevated").join(member, "account_id", "left")
    return joined.withColumn("exempt", F.coalesce("exempt", F.lit(False))).withColumn("elevated", F.coalesce("elevated", F.lit(False)))


def outbox_rows(alerts: DataFrame, now: Column, trace: Column | None = None) -> DataFrame:
    """Alerts as rows of the outbox: id, account_id, payload (the message's JSON), status, attempts, created_at and the trace of
    the event (a struct as of trace_of), null where it had none."""
    message = F.struct(
        F.col("alert_id").alias("alertId"), F.col("event_id").alias("eventId"), F.col("account_id").alias("accountId"), F.col("rule_name").alias("ruleName"),
        "reason", instant_text(F.col("produced_us")).alias("producedAt"),
    )
    parent, state = (F.lit(None).cast("string"), F.lit(None).cast("string")) if trace is None else (trace["traceparent"], trace["tracestate"])
    return alerts.select(
        F.col("alert_id").alias("id"), "account_id", F.to_json(message, {"ignoreNullFields": "false"}).alias("payload"), F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempts"), now.alias("created_at"), parent.alias("traceparent"), state.alias("tracestate"),
    )


def fresh(events: DataFrame, t: Thresholds) -> DataFrame:
    """events without the copies that come less than dedup_ttl_ms after an accepted one; copies at one time are taken in the
    order of `arrival` if there is such a column."""
    if "arrival" in events.columns:
        return dedup_ttl(events, t.dedup_ttl_ms).filter("accepted").drop("accepted")
    placed = events.withColumn("arrival", F.struct("produced_us", "account_id", "amount", "lat", "lon"))
    return dedup_ttl(placed, t.dedup_ttl_ms).filter("accepted").drop("accepted", "arrival")


def judge(events: DataFrame, t: Thresholds, restart: bool = True) -> DataFrame:
    """events with all that the rules look at, without blocked copies, which change no state. Every other event enters all
    three states, whichever rule fires. Statistics restart after the account has been idle for longer than stats_ttl_ms,
    unless restart is False. What comes before the account's states is written once, and statistics and previous place are
    taken in one pass."""
    counted = written(velocity(fresh(events, t), t.velocity_window_ms), "counted")
    return _moved(capped_welford(counted, t.zscore_cap, ttl_ms=t.stats_ttl_ms if restart else None, previous=_PLACE), t.geo_ttl_ms)
