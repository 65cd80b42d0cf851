"""Record schemas and default parameters."""

from __future__ import annotations

from dataclasses import dataclass

PAYMENT_EVENT = "eventId string, accountId string, amount decimal(38,18), lat decimal(38,18), lon decimal(38,18), timestamp timestamp, schemaVersion string"
ALERT_MESSAGE = "alertId string, eventId string, accountId string, ruleName string, reason string, producedAt timestamp"
PAYMENT_ALERT = f"{ALERT_MESSAGE}, schemaVersion string"
VERDICT = "severity string, narrative string, evidence array<struct<toolCallId:string,finding:string>>, confidence double"

#: Fixed values that must equal those of the system whose results are matched.
ALERT_NAMESPACE = "a6e4c1b8-4e2d-5f3a-9b0c-1d2e3f4a5b6c"
EARTH_RADIUS_KM = 6371.0
RULES = ("velocity", "zscore", "geo")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
MS_PER_HOUR = 3_600_000


@dataclass(frozen=True)
class Thresholds:
    """Parameters of the detection rules, with their defaults."""

    velocity_window_ms: int = 60_000
    velocity_max: int = 100
    zscore_min_count: int = 30
    zscore_threshold: float = 3.0
    zscore_cap: int = 10_000
    geo_max_kmh: float = 900.0
    geo_ttl_ms: int = 24 * MS_PER_HOUR
    stats_ttl_ms: int = 30 * 24 * MS_PER_HOUR
    dedup_ttl_ms: int = 300_000
    rate_default: int = 500
    rate_elevated: int = 2000
    bucket_ttl_ms: int = 60_000
