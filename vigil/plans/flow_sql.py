"""SQL for the queries of the whole flow, and for those of alert texts and percentiles."""

from __future__ import annotations

from vigil.plans.reference_sql import _ELEVATED, _EXEMPT, _FIRED, _HEX, _HOUR, _HYPHENS, _JUDGED, _M, _MOVE, _NOW, _STATS, _UPTO, _VEL, _E, _Z, _uuid5  # noqa: F401


def _iso(us: str) -> str:
    return (
        f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN '' WHEN {us} % 1000 = 0 THEN '.' || lpad(({us} % 1000000 // 1000)::VARCHAR, 3, '0') "
        f"ELSE '.' || lpad(({us} % 1000000)::VARCHAR, 6, '0') END || 'Z'"
    )


_REASON = f"""CASE rule_name WHEN 'velocity' THEN velocity_prior || ' events in window (max=3)' WHEN 'zscore' THEN printf('z=%.2f > threshold=%.1f', {_Z}, 3.0::DOUBLE)
 ELSE printf('speed=%.1f km/h > max=%.1f km/h (dist=%.1f km, delta=%d ms)', speed_kmh, 900.0::DOUBLE, dist_km, ms - m0) END"""

_COPIES = """c AS (SELECT *, 0 AS arrival FROM e UNION ALL SELECT * REPLACE (ms + 120000 AS ms), 1 FROM e WHERE event_id::BIGINT % 10 = 0
 UNION ALL SELECT * REPLACE (ms + 600000 AS ms), 2 FROM e WHERE event_id::BIGINT % 25 = 0)"""
#: Deliveries with copies, of which blocked ones are left out, through all rules; statistics restart after a day's pause.
_GATE = ", ".join([
    _E, _COPIES, "o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ms, arrival) AS nth FROM c)",
    """x AS (SELECT event_id, nth, ms AS last, true AS accepted FROM o WHERE nth = 1
 UNION ALL SELECT o.event_id, o.nth, CASE WHEN o.ms - x.last >= 300000 THEN o.ms ELSE x.last END, o.ms - x.last >= 300000 FROM x JOIN o ON o.event_id = x.event_id AND o.nth = x.nth + 1)""",
    "b AS (SELECT o.* FROM o JOIN x USING (event_id, nth) WHERE accepted)", _VEL.replace("FROM e)", "FROM b)"),
    f"i AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY account_id ORDER BY ms, event_id) > {24 * _HOUR} THEN 1 ELSE 0 END AS idle FROM v)",
    f"j AS (SELECT *, sum(idle) OVER (PARTITION BY account_id {_UPTO}) AS epoch FROM i)", _STATS.format(of="j", keys="account_id, epoch"), _MOVE.format(of="s"), _FIRED,
])
_ALERT = _uuid5("event_id || ':' || rule_name")
_GATE_ALERTS = f"SELECT {_ALERT} AS alert_id, event_id, account_id, rule_name, {_REASON} AS reason, produced_us FROM f WHERE rule_name IS NOT NULL"

_BUCKETS = [1000, 5000, 30000, 60000, 300000, 3600000]
_TIMES = "SELECT rule_name, epoch_us(acted_at) // 1000 - epoch_us(produced_at) // 1000 AS ms FROM processed_alerts"
_HISTOGRAM = " UNION ALL ".join([*[f"SELECT rule_name, '{b}' AS le, {b}::DOUBLE AS bound, count(*) FILTER (ms <= {b}) AS n FROM t GROUP BY rule_name" for b in _BUCKETS], "SELECT rule_name, '+Inf', 'inf'::DOUBLE, count(ms) FROM t GROUP BY rule_name"])


def _quantile(p: float) -> str:
    return f"""(SELECT rule_name, CASE WHEN arg_min(bound, bound) = 'inf'::DOUBLE THEN arg_min(low, bound) ELSE arg_min(low + (bound - low) * ({p} * total - below) / (n - below), bound) END AS q
 FROM w WHERE n >= {p} * total AND total > 0 GROUP BY rule_name)"""


_STEPS = """SELECT {keys}, epoch_us(received_at) // 900000000 * 900000000 AS window_us, {value} AS v, lag({value}) OVER (PARTITION BY {keys} ORDER BY received_at, offset_no) AS p FROM {of} WHERE received_at IS NOT NULL"""
_STEP = "CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END"
_ACCOUNTS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ms DESC, event_id DESC) AS rank FROM e),
 h AS (SELECT account_id, count(*) AS n, round(avg(amount) + 1e-7, 4) AS mean, max(ms) AS last_ms, list(event_id ORDER BY rank) FILTER (rank <= 20) AS recent FROM r GROUP BY account_id)"""
_FAULTS = ["none", "tombstone", "undecodable", "invalid", "rate-breach", "contract-violation", "circuit-open", "not-durable", "gate-error", "listener-error", "whatever"]

SQL = {
    "gate_alerts": f"WITH RECURSIVE {_GATE} {_GATE_ALERTS}",
    "alert_reasons": f"WITH {_JUDGED}, {_FIRED} SELECT event_id, rule_name, {_REASON} AS reason FROM f WHERE rule_name IS NOT NULL",
    "pipeline_alerts": f"""WITH RECURSIVE {_GATE}, fired AS ({_GATE_ALERTS}) SELECT alert_id AS id, account_id, json_object('alertId', alert_id, 'eventId', event_id, 'accountId', account_id, 'ruleName', rule_name,
 'reason', reason, 'producedAt', {_iso('produced_us')})::VARCHAR AS payload, 'PENDING' AS status, 0 AS attempts, {_NOW} AS created_us,
 CASE WHEN event_id::BIGINT % 4 <> 0 THEN '00-' || md5(event_id) || '-' || md5(event_id)[1:16] || '-01' END AS traceparent, NULL::VARCHAR AS tracestate FROM fired""",
    "throttled": f"""WITH RECURSIVE {_E}, o AS (SELECT event_id, account_id, ms // 86400 AS ms, CASE WHEN account_id::BIGINT % 11 = 0 THEN 0 ELSE 2 END AS rate,
 row_number() OVER (PARTITION BY account_id ORDER BY ms // 86400, event_id::BIGINT) AS i FROM e),
 r AS (SELECT account_id, i, event_id, rate >= 1 AS admitted, CASE WHEN rate >= 1 THEN 0 ELSE 5000 END::BIGINT AS delay_ms, CASE WHEN rate >= 1 THEN ms ELSE ms + 5000 END AS lane,
 greatest(rate - 1, 0)::DOUBLE AS tokens FROM o WHERE i = 1
 UNION ALL SELECT account_id, i, event_id, rate >= 1, (now + wait - ms)::BIGINT, now + wait, CASE WHEN rate < 1 THEN 0 WHEN wait = 0 THEN t - 1 ELSE least(rate::DOUBLE, t + wait / 1000.0::DOUBLE * rate) - 1 END
 FROM (SELECT *, CASE WHEN rate < 1 THEN 5000 WHEN t >= 1 THEN 0 ELSE ceil((1 - t) / rate * 1000) END AS wait
 FROM (SELECT *, CASE WHEN now - lane > 60000 THEN rate::DOUBLE ELSE least(rate::DOUBLE, tokens + (now - lane) / 1000.0::DOUBLE * rate) END AS t
 FROM (SELECT o.account_id, o.i, o.event_id, o.ms, o.rate, r.tokens, r.lane, greatest(o.ms, r.lane) AS now FROM r JOIN o ON o.account_id = r.account_id AND o.i = r.i + 1))))
 SELECT event_id, admitted, delay_ms FROM r""",
    "identity_validation": f"""WITH {_M}, x AS (SELECT row_id, concat_ws(',', CASE WHEN u IS NULL THEN 'alert_id' END, CASE WHEN account_id IS NULL THEN 'account_id' END, CASE WHEN rule_name IS NULL THEN 'rule_name' END) AS missing FROM m)
 SELECT row_id, missing, 'payment.alerts.triage.DLT' AS topic, -1::BIGINT AS partition FROM x WHERE missing <> ''""",
    "reply_validation": "SELECT row_id, ['', '', 'shape', 'shape', 'geo', 'geo', 'geo'][row_id % 7 + 1] AS fault FROM alert_messages",
    "terminal_paths": f"""WITH x AS (SELECT row_id, {_FAULTS}[offset_no % 11 + 1] AS fault FROM alert_messages),
 y AS (SELECT *, CASE WHEN fault IN ('none', 'tombstone') THEN 'ack' WHEN fault = 'circuit-open' THEN 'hold' ELSE 'dead-letter' END AS action FROM x)
 SELECT row_id, action, CASE WHEN fault IN ('gate-error', 'listener-error', 'whatever') THEN 2 ELSE 0 END::BIGINT AS retries,
 CASE WHEN fault = 'gate-error' THEN 100 WHEN fault IN ('listener-error', 'whatever') THEN 1000 ELSE 0 END::BIGINT AS backoff_ms, action = 'ack' OR action = 'dead-letter' AND row_id % 5 <> 0 AS acked FROM y""",
    "undurable_letters": f"""SELECT row_id, 'payment.events' AS dest, 'payment.events.DLT' AS origin, '2020-06-15T00:00:00Z' AS redriven_at, CASE WHEN rule_name IS NULL THEN 'dead-letter' ELSE 'emit' END AS action,
 CASE WHEN rule_name IS NOT NULL THEN {_uuid5("event_id || ':' || rule_name")} END AS alert_id, CASE WHEN rule_name IS NOT NULL THEN coalesce(reason, 'reconstructed-from-redrive') END AS reason,
 3 + CASE WHEN rule_name IS NULL THEN 0 WHEN reason IS NULL THEN 2 ELSE 3 END::BIGINT AS n_headers FROM alert_messages""",
    "trace_publish": """WITH x AS (SELECT *, coalesce(regexp_full_match(traceparent, '00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}'), false) AS goes_on FROM outbox)
 SELECT id, CASE WHEN goes_on THEN traceparent[4:35] END AS trace_id, CASE WHEN goes_on THEN nullif(trim(tracestate), '') END AS tracestate, goes_on FROM x""",
    "plain_numbers": "SELECT event_id, (value / 1024 / 1024)::DECIMAL(38, 9)::VARCHAR AS digits FROM events",
    "triage_inbox": f"""WITH {_M}, n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY row_id) AS nth FROM m WHERE u IS NOT NULL AND account_id IS NOT NULL AND rule_name IS NOT NULL
 AND u NOT IN (SELECT u FROM (SELECT {_HEX} AS u FROM triaged_alerts) WHERE u IS NOT NULL))
 SELECT {_HYPHENS.format(u='u')} AS alert, row_id, account_id, rule_name, 'PENDING_TRIAGE' AS triage_status FROM n WHERE nth = 1""",
    "triage_marks": """SELECT row_id, CASE WHEN row_id % 2 = 0 AND triage_status = 'PENDING_TRIAGE' THEN 'DEGRADED_RULE_BASED' ELSE triage_status END AS triage_status,
 CASE WHEN row_id % 2 <> 0 THEN '' WHEN triage_status = 'PENDING_TRIAGE' THEN 'recorded' ELSE 'lost' END AS mark FROM triaged_alerts""",
    "triage_messages": f"""WITH t AS (SELECT *, {_HEX} AS u FROM triaged_alerts WHERE triage_status = 'PENDING_TRIAGE') SELECT row_id, json_object('alertId', {_HYPHENS.format(u='u')}, 'eventId', NULL, 'accountId', account_id,
 'ruleName', rule_name, 'severity', CASE WHEN rule_name = 'geo' THEN 'HIGH' ELSE 'MEDIUM' END, 'narrative', 'Rule-based severity (LLM triage unavailable): ' || rule_name || ' alert.', 'evidence', [], 'confidence', 0.0::DOUBLE,
 'triageStatus', 'DEGRADED_RULE_BASED', 'promptVersion', 'triage-v2', 'evidenceStripped', false, 'toolRounds', 0, 'degradedReason', 'stale-pending-sweep', 'triagedAt', '2020-06-15T00:00:00Z', 'schemaVersion', '1')::VARCHAR AS message FROM t""",
    "tool_recent_alerts": f"""WITH r AS (SELECT account_id, rule_name, epoch_us(produced_at) AS us, row_number() OVER (PARTITION BY account_id ORDER BY produced_at DESC NULLS LAST, row_id) AS rank FROM processed_alerts)
 SELECT account_id, json_object('recentAlerts', list(json_object('ruleName', rule_name, 'producedAt', {_iso('us')}) ORDER BY rank))::VARCHAR AS reply FROM r WHERE rank <= 20 GROUP BY account_id""",
    "tool_history": f"""WITH {_E}, {_ACCOUNTS} SELECT account_id, CASE WHEN account_id::BIGINT % 5 = 0 THEN '{{"error":"account mismatch: tools may only query the alert''s own account"}}'
 ELSE json_object('stats', json_object('eventCount', n::VARCHAR, 'meanAmount', mean::DECIMAL(18, 4)::VARCHAR), 'lastLocationTimestampMs', last_ms::VARCHAR, 'recentEventIdsInWindow', recent)::VARCHAR END AS reply FROM h""",
    "latency_histogram": f"WITH t AS ({_TIMES}) SELECT rule_name, le, n FROM ({_HISTOGRAM})",
    "latency_quantiles": f"""WITH t AS ({_TIMES}), g AS ({_HISTOGRAM}), w AS (SELECT *, coalesce(lag(bound) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS below, max(n) OVER (PARTITION BY rule_name) AS total FROM g
 WINDOW o AS (PARTITION BY rule_name ORDER BY bound)) SELECT rule_name, round(coalesce(a.q, -1) + 1e-7, 3) AS p95, round(coalesce(b.q, -1) + 1e-7, 3) AS p99
 FROM (SELECT DISTINCT rule_name FROM t) LEFT JOIN {_quantile(0.95)} AS a USING (rule_name) LEFT JOIN {_quantile(0.99)} AS b USING (rule_name)""",
    "latency_percentiles_exact": f"""SELECT rule_name, count(ms) AS n, quantile_disc(ms, 0.5) AS p5, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99 FROM ({_TIMES}) GROUP BY rule_name""",
    "counter_increase": f"""SELECT partition_no, window_us, sum({_STEP})::BIGINT AS increase, round(sum({_STEP}) / 900.0, 6) AS per_second
 FROM ({_STEPS.format(keys='partition_no', value='offset_no % 500', of='alert_messages')}) GROUP BY ALL""",
    "failed_percent": """SELECT epoch_us(created_at) // 3600000000 * 3600000000 AS hour_us, round(100.0 * count(*) FILTER (status = 'FAILED') / count(*) + 1e-9, 6) AS percent FROM outbox GROUP BY ALL""",
    "attempts_percent": "SELECT status, max(attempts) * 100.0::DOUBLE / 5 AS percent FROM outbox GROUP BY status",
    "depth_alarms": f"""WITH x AS (SELECT *, 't' || batch_id % 4 || CASE WHEN batch_id % 4 = 3 THEN '.parked' ELSE '' END AS topic FROM alert_messages),
 s AS (SELECT topic, window_us, sum({_STEP}) AS n FROM ({_STEPS.format(keys='topic, partition_no', value='offset_no', of='x')}) GROUP BY ALL)
 SELECT topic, 'growing' AS alarm, max(n)::BIGINT AS n FROM s WHERE topic NOT LIKE '%.parked' GROUP BY topic HAVING max(n) > 100
 UNION ALL SELECT topic, 'parked', sum(n)::BIGINT FROM (SELECT topic, max(offset_no) - min(offset_no) + 1 AS n FROM x WHERE topic LIKE '%.parked' GROUP BY topic, partition_no) GROUP BY topic""",
    "stored_times": f"SELECT id, {_iso('us')} AS created FROM (SELECT id, epoch_us(created_at) AS us FROM outbox)",
}
