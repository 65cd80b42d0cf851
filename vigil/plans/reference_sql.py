"""SQL for the event-pipeline queries, each over whole tables, with the same column names."""

from __future__ import annotations

_HEX = r"regexp_replace(regexp_replace(lower(alert_id), '^\s*(urn:uuid:)?[{(]?|[)}]?\s*$', '', 'g'), '-', '', 'g')"
_HEX = f"CASE WHEN regexp_full_match({_HEX}, '[0-9a-f]{{32}}') THEN {_HEX} END"
_HYPHENS = "{u}[1:8] || '-' || {u}[9:12] || '-' || {u}[13:16] || '-' || {u}[17:20] || '-' || {u}[21:32]"
_NOW = "1592179200000000"
_HOUR = 3600000

_E = """e AS (SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS account_id, value AS amount,
 ((k * 37) % 181 - 90)::DOUBLE AS lat, ((k * 61) % 361 - 180)::DOUBLE AS lon, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS produced_us
 FROM (SELECT *, (props->>'$.k')::INT AS k FROM events) WHERE value >= 0)"""
_VEL = f"""v AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY ms RANGE BETWEEN {6 * _HOUR - 1} PRECEDING AND 1 PRECEDING)
 + row_number() OVER (PARTITION BY account_id, ms ORDER BY event_id) - 1 AS velocity_prior FROM e)"""
_UPTO = "ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_STATS = f"""s AS (SELECT *, count(*) OVER w AS n, avg(amount) OVER w AS mean, var_pop(amount) OVER w AS variance FROM {{of}}
 WINDOW w AS (PARTITION BY {{keys}} {_UPTO}))"""
_MOVE = f"""p AS (SELECT *, lag(ms) OVER w AS m0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM {{of}} WINDOW w AS (PARTITION BY account_id ORDER BY ms, event_id)),
 q AS (SELECT * REPLACE (CASE WHEN ms - m0 <= {24 * _HOUR} THEN m0 END AS m0, CASE WHEN ms - m0 <= {24 * _HOUR} THEN lat0 END AS lat0, CASE WHEN ms - m0 <= {24 * _HOUR} THEN lon0 END AS lon0) FROM p),
 a AS (SELECT *, pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lon0)) / 2), 2) AS h FROM q),
 d AS (SELECT *, 12742.0 * atan2(sqrt(h), sqrt(greatest(0, 1 - h))) AS dist_km FROM a),
 g AS (SELECT *, CASE WHEN ms - m0 > 0 THEN dist_km / ((ms - m0) / 3600000.0) END AS speed_kmh FROM d)"""
_Z = "abs(amount - mean) / sqrt(variance)"
_ZFIRES = f"n >= 30 AND variance > 1e-12 AND {_Z} > 3.0"
_EXEMPT, _ELEVATED = "account_id::BIGINT % 10 = 0", "account_id::BIGINT % 7 = 0"
_JUDGED = ", ".join([_E, _VEL, _STATS.format(of="v", keys="account_id"), _MOVE.format(of="s")])
_FIRED = f"""f AS (SELECT *, CASE WHEN velocity_prior >= 3 THEN 'velocity' WHEN {_ZFIRES} THEN 'zscore'
 WHEN speed_kmh > 900 AND NOT {_EXEMPT} THEN 'geo' END AS rule_name FROM g)"""


def _uuid5(name: str) -> str:
    digest = f"sha1(unhex('a6e4c1b84e2d5f3a9b0c1d2e3f4a5b6c') || encode({name}))"
    return (
        f"{digest}[1:8] || '-' || {digest}[9:12] || '-5' || {digest}[14:16] || '-' || "
        f"substr('89ab', 1 + (('0x' || {digest}[17:17])::INT % 4), 1) || {digest}[18:20] || '-' || {digest}[21:32]"
    )


_M = f"m AS (SELECT *, {_HEX} AS u FROM alert_messages)"
_VERDICT = "v AS (SELECT row_id, verdict::JSON AS v FROM triaged_alerts WHERE verdict IS NOT NULL)"

SQL = {
    "event_validation": """SELECT event_id::VARCHAR AS event_id, (CASE WHEN value - 5 < 0 THEN 1 ELSE 0 END + CASE WHEN abs(((k * 37) % 181 - 90) * 1.02::DOUBLE) > 90 THEN 1 ELSE 0 END)::BIGINT AS violations
 FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""",
    "velocity_counts": f"WITH {_E}, {_VEL} SELECT event_id, velocity_prior FROM v",
    "velocity_alerts": f"""WITH {_E}, {_VEL} SELECT {_uuid5("event_id || ':velocity'")} AS alert_id, event_id, account_id, 'velocity' AS rule_name,
 velocity_prior || ' events in window (max=3)' AS reason, produced_us FROM v WHERE velocity_prior >= 3""",
    "running_stats": f"WITH {_E}, {_STATS.format(of='e', keys='account_id')} SELECT event_id, n, round(mean + 1e-7, 4) AS mean, round(variance + 1e-7, 4) AS variance FROM s",
    "zscore_alerts": f"WITH {_E}, {_STATS.format(of='e', keys='account_id')} SELECT event_id, account_id, n, round({_Z} + 1e-7, 4) AS z FROM s WHERE {_ZFIRES}",
    "stats_idle_reset": f"""WITH {_E}, i AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY account_id ORDER BY ms, event_id) > {24 * _HOUR} THEN 1 ELSE 0 END AS idle FROM e),
 j AS (SELECT *, (sum(idle) OVER (PARTITION BY account_id {_UPTO}))::BIGINT AS epoch FROM i), {_STATS.format(of='j', keys='account_id, epoch')}
 SELECT event_id, epoch, n, round(mean + 1e-7, 4) AS mean, round(variance + 1e-7, 4) AS variance FROM s""",
    "geo_speed": f"WITH {_E}, {_MOVE.format(of='e')} SELECT event_id, coalesce(m0, 0) AS prev_ms, round(dist_km, 3) AS dist_km, round(speed_kmh, 3) AS speed_kmh FROM g",
    "account_classes": f"WITH {_E} SELECT event_id, {_EXEMPT} AS exempt, {_ELEVATED} AS elevated, (CASE WHEN {_ELEVATED} THEN 2000 ELSE 500 END)::BIGINT AS rate FROM e",
    "geo_alerts": f"WITH {_E}, {_MOVE.format(of='e')} SELECT event_id, account_id, round(speed_kmh, 3) AS speed_kmh FROM g WHERE speed_kmh > 900 AND NOT {_EXEMPT}",
    "alerts_all": f"""WITH {_JUDGED}, {_FIRED} SELECT {_uuid5("event_id || ':' || rule_name")} AS alert_id, event_id, account_id, rule_name, produced_us FROM f WHERE rule_name IS NOT NULL""",
    "clean_reasons": f"""WITH {_JUDGED} SELECT event_id, CASE WHEN velocity_prior < 3 THEN 'velocity:ok' END AS velocity,
 CASE WHEN n < 30 THEN 'zscore:insufficient-history' WHEN variance <= 1e-12 THEN 'zscore:stddev=0,all-amounts-identical' WHEN NOT ({_ZFIRES}) THEN 'zscore:ok' END AS zscore,
 CASE WHEN {_EXEMPT} THEN 'geo:exempt' WHEN m0 IS NULL THEN 'geo:no-prior-location' WHEN ms - m0 <= 0 THEN 'geo:non-positive-time-delta' WHEN NOT speed_kmh > 900 THEN 'geo:ok' END AS geo FROM g""",
    "masking": """SELECT row_id, CASE WHEN length(account_id) >= 4 THEN right(account_id, 4) ELSE '****' END AS account,
 CASE WHEN length(event_id) >= 8 THEN right(event_id, 8) ELSE '****' END AS event FROM alert_messages""",
    "dedup_ttl": f"""WITH RECURSIVE {_E}, c AS (SELECT event_id, ms, 0 AS arrival FROM e UNION ALL SELECT event_id, ms + 120000, 1 FROM e WHERE event_id::BIGINT % 10 = 0
 UNION ALL SELECT event_id, ms + 600000, 2 FROM e WHERE event_id::BIGINT % 25 = 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ms, arrival) AS i FROM c),
 r AS (SELECT event_id, i, ms, true AS accepted, ms AS last FROM o WHERE i = 1
 UNION ALL SELECT o.event_id, o.i, o.ms, o.ms - r.last >= 300000, CASE WHEN o.ms - r.last >= 300000 THEN o.ms ELSE r.last END FROM r JOIN o ON o.event_id = r.event_id AND o.i = r.i + 1)
 SELECT event_id, ms, accepted FROM r""",
    "welford_capped": f"""WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ms, event_id) AS i FROM e),
 r AS (SELECT account_id, i, event_id, amount AS mean, 0.0::DOUBLE AS m2 FROM o WHERE i = 1
 UNION ALL SELECT o.account_id, o.i, o.event_id, r.mean + (o.amount - r.mean) / least(o.i, 20),
 (CASE WHEN o.i > 20 THEN r.m2 - r.m2 / 20 ELSE r.m2 END) + (o.amount - r.mean) * (o.amount - (r.mean + (o.amount - r.mean) / least(o.i, 20)))
 FROM r JOIN o ON o.account_id = r.account_id AND o.i = r.i + 1) SELECT event_id, i AS n, round(mean + 1e-7, 4) AS mean, round(m2 + 1e-7, 3) AS m2 FROM r""",
    "token_bucket": f"""WITH RECURSIVE {_E}, o AS (SELECT event_id, account_id, ms // 86400 AS ms, row_number() OVER (PARTITION BY account_id ORDER BY ms // 86400, event_id::BIGINT) AS i FROM e),
 r AS (SELECT account_id, i, event_id, ms, 2.0::DOUBLE AS tokens FROM o WHERE i = 1
 UNION ALL SELECT o.account_id, o.i, o.event_id, o.ms, CASE WHEN o.ms - r.ms > 60000 THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE,
 (CASE WHEN r.tokens >= 1 THEN r.tokens - 1 ELSE r.tokens END) + greatest(0, o.ms - r.ms) / 1000.0::DOUBLE * 2) END FROM r JOIN o ON o.account_id = r.account_id AND o.i = r.i + 1)
 SELECT event_id, tokens >= 1 AS allowed, CASE WHEN tokens >= 1 THEN 0 ELSE ceil((1 - tokens) / 2 * 1000) END::BIGINT AS wait_ms FROM r""",
    "processed_insert": f"""WITH {_M} SELECT {_HYPHENS.format(u='u')} AS alert, min(row_id) AS row_id FROM m WHERE u IS NOT NULL
 AND u NOT IN (SELECT u FROM (SELECT {_HEX} AS u FROM processed_alerts) WHERE u IS NOT NULL) GROUP BY u""",
    "actioned_counts": f"""WITH {_M} SELECT rule_name, CASE WHEN nth = 1 THEN 'actioned' ELSE 'duplicate' END AS outcome, count(*) AS n
 FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY row_id) AS nth FROM m WHERE u IS NOT NULL) GROUP BY ALL""",
    "outbox_stats": """SELECT count(*) FILTER (status = 'PENDING') AS pending, epoch_us(min(created_at) FILTER (status = 'PENDING')) AS oldest_us,
 count(*) FILTER (status = 'FAILED') AS failed FROM outbox""",
    "outbox_purge": f"SELECT id, status, epoch_us(created_at) AS created_us FROM outbox WHERE NOT (status = 'PUBLISHED' AND epoch_us(created_at) < {_NOW} - 604800000000)",
    "processed_purge": f"SELECT row_id, coalesce(epoch_us(acted_at), 0) AS acted_us FROM processed_alerts WHERE acted_at IS NULL OR epoch_us(acted_at) >= {_NOW} - 864000000000",
    "outbox_next_batch": "SELECT id, attempts FROM outbox WHERE status = 'PENDING' AND attempts < 5 ORDER BY created_at, id LIMIT 50",
    "outbox_retry": """WITH t AS (SELECT *, status = 'PENDING' AND attempts < 5 AS tried, right(id, 1) BETWEEN '0' AND '7' AS failed FROM outbox)
 SELECT id, CASE WHEN tried AND NOT failed THEN 'PUBLISHED' WHEN status = 'PENDING' AND attempts + tried::INT >= 5 THEN 'FAILED' ELSE status END AS status,
 (attempts + tried::INT)::BIGINT AS attempts FROM t""",
    "outbox_fields": """SELECT id, payload->>'$.eventId' AS event_id, payload->>'$.ruleName' AS rule_name,
 coalesce(regexp_full_match(traceparent, '00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}'), false) AS traced FROM outbox""",
    "payload_decode": """SELECT id, NOT json_valid(payload) AS poison, payload->>'$.alertId' AS alert_id, epoch_us((payload->>'$.producedAt')::TIMESTAMPTZ) AS produced_us FROM outbox""",
    "recent_alerts": """SELECT account_id, rank, row_id, rule_name, epoch_us(produced_at) AS produced_us FROM (SELECT *,
 row_number() OVER (PARTITION BY account_id ORDER BY produced_at DESC NULLS LAST, row_id) AS rank FROM processed_alerts) WHERE rank <= 20""",
    "account_history": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ms DESC, event_id DESC) AS rank FROM e)
 SELECT account_id, count(*) AS event_count, round(avg(amount) + 1e-7, 4) AS mean_amount, max(ms) AS last_ms, string_agg(event_id, ',' ORDER BY rank) FILTER (rank <= 20) AS recent FROM r GROUP BY account_id""",
    "triage_status_counts": "SELECT triage_status, count(*) AS n FROM triaged_alerts GROUP BY ALL",
    "verdict_validation": f"""WITH {_VERDICT} SELECT row_id, ((CASE WHEN v->>'$.severity' IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN 0 ELSE 1 END)
 + (CASE WHEN trim(coalesce(v->>'$.narrative', '')) = '' THEN 1 ELSE 0 END) + (CASE WHEN json_type(v, '$.evidence') = 'ARRAY' THEN 0 ELSE 1 END)
 + (CASE WHEN (v->>'$.confidence')::DOUBLE BETWEEN 0 AND 1 THEN 0 ELSE 1 END)
 + (CASE WHEN len(list_filter(v->>'$.evidence[*].toolCallId', lambda x: trim(coalesce(x, '')) = '')) > 0 THEN 1 ELSE 0 END))::BIGINT AS faults FROM v""",
    "evidence_grounding": f"""WITH {_VERDICT}, k AS (SELECT row_id, len(v->>'$.evidence[*].toolCallId') AS total,
 len(list_filter(v->>'$.evidence[*].toolCallId', lambda x: regexp_matches(x, '[02468]$'))) AS kept, (v->>'$.confidence')::DOUBLE AS c FROM v)
 SELECT row_id, kept, total > 0 AND kept = 0 AS stripped, CASE WHEN total > 0 AND kept = 0 THEN least(c, 0.2) ELSE c END AS confidence FROM k""",
    "triage_degraded": """SELECT row_id, CASE WHEN rule_name = 'geo' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 'Rule-based severity (LLM triage unavailable): ' || rule_name || ' alert.' AS narrative, 0.0::DOUBLE AS confidence, 'llm-unavailable' AS degraded_reason
 FROM triaged_alerts WHERE triage_status = 'PENDING_TRIAGE'""",
    "triage_sweep": f"""SELECT row_id, CASE WHEN rule_name = 'geo' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'stale-pending-sweep' AS degraded_reason
 FROM triaged_alerts WHERE triage_status = 'PENDING_TRIAGE' AND epoch_us(created_at) < {_NOW} - 300000000 ORDER BY created_at, row_id LIMIT 50""",
    "redrive_route": """WITH t AS (SELECT row_id, ['payment.events.DLT', 'payment.alerts.DLT', 'payment.alerts.triage.DLT', 'payment.other.DLT'][partition_no + offset_no % 2 + 1] AS topic,
 CASE WHEN offset_no % 6 = 5 THEN 0 ELSE offset_no % 6 END AS a FROM alert_messages)
 SELECT row_id, topic, CASE WHEN topic = 'payment.other.DLT' THEN NULL WHEN a >= 3 THEN topic || '.parked'
 WHEN topic = 'payment.events.DLT' THEN 'payment.events' ELSE 'payment.alerts' END AS dest, (a + 1)::VARCHAR AS next FROM t""",
    "redrive_reconstruct": f"""SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'ack' WHEN 1 THEN 'dead-letter' ELSE 'emit' END AS action,
 CASE WHEN row_id % 3 = 2 THEN 'velocity' END AS rule_name, CASE WHEN row_id % 3 = 2 THEN 'reconstructed-from-redrive' END AS reason,
 CASE WHEN row_id % 3 = 2 THEN {_uuid5("event_id || ':velocity'")} END AS alert_id FROM alert_messages""",
    "topic_depth": """SELECT topic, sum(n)::BIGINT AS depth FROM (SELECT 't' || batch_id % 4 AS topic, partition_no, max(offset_no) - min(offset_no) + 1 AS n
 FROM alert_messages GROUP BY ALL) GROUP BY topic""",
    "consumer_lag": """SELECT 'payment.alerts' AS topic, sum(CASE WHEN partition_no < 2 THEN e - (e * 9) // 10 ELSE e END)::BIGINT AS lag
 FROM (SELECT partition_no, max(offset_no) + 1 AS e FROM alert_messages GROUP BY ALL)""",
    "offset_change": """SELECT partition_no, epoch_us(received_at) // 900000000 * 900000000 AS window_us, max(offset_no) AS highest,
 max_by(offset_no, (received_at, offset_no)) - min_by(offset_no, (received_at, offset_no)) AS change FROM alert_messages GROUP BY ALL""",
}
