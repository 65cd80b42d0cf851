"""SQL for the queries of problems 1 to 5, where SQL can say it; written from the statements, not from the operators."""

from __future__ import annotations

#: The UUID a text denotes, as 32 hex digits, or null.
_HEX = r"regexp_replace(regexp_replace(lower(alert_id), '^\s*(urn:uuid:)?[{(]?|[)}]?\s*$', '', 'g'), '-', '', 'g')"
_UUID = f"CASE WHEN regexp_full_match({_HEX}, '[0-9a-f]{{32}}') THEN {_HEX} END"
_HYPHENS = "u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32]"

_ACCOUNTS = """SELECT 'outbox' AS table_name, account_id, id AS alert, created_at AS ts FROM outbox
UNION ALL SELECT 'processed_alerts', account_id, alert_id, acted_at FROM processed_alerts"""

_CLOCKS = """SELECT *, max(p) OVER (PARTITION BY table_name ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM (
 SELECT 'alert_messages' AS table_name, row_id, epoch_us(produced_at) AS p, epoch_us(received_at) AS a FROM alert_messages
 UNION ALL SELECT 'processed_alerts', row_id, epoch_us(produced_at), epoch_us(acted_at) FROM processed_alerts) WHERE p IS NOT NULL AND a IS NOT NULL"""
_LATE = f"""SELECT *, CASE WHEN clock >= e + 21600000000 THEN 'too_late' WHEN clock >= e THEN 'corrects' ELSE 'on_time' END AS lateness
 FROM (SELECT *, p - p % 3600000000 + 3600000000 AS e FROM ({_CLOCKS}))"""

_REPEATED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {_HYPHENS} AS alert_id FROM (SELECT {_UUID} AS u FROM {t}) WHERE u IS NOT NULL GROUP BY u HAVING count(*) > 1"
    for t in ("alert_messages", "processed_alerts", "triaged_alerts")
)

_LATEST = f"""SELECT account_id, rule_name, epoch_us(produced_at) AS ts FROM (
 SELECT *, row_number() OVER (PARTITION BY coalesce({_UUID}, 'row ' || row_id) ORDER BY row_id DESC) AS nth FROM processed_alerts) WHERE nth = 1"""

#: A name as part of a column: a readable part and a hash.
_SLUG = r"left(trim(regexp_replace(lower(rule_name), '[^a-z0-9]+', '_', 'g'), '_'), 40) || '_' || left(sha1(rule_name), 8)"
_WIDE = f"""WITH latest AS ({_LATEST}),
 counted AS (SELECT account_id, {_SLUG} AS slug, count(*) AS n, max(ts) AS latest_us FROM latest WHERE rule_name IS NOT NULL GROUP BY account_id, rule_name),
 cells AS (SELECT coalesce(account_id, '<null>') AS account_id, 'n_' || slug AS name, n AS v FROM counted
 UNION ALL SELECT coalesce(account_id, '<null>'), 'latest_' || slug, latest_us FROM counted
 UNION ALL SELECT coalesce(account_id, '<null>'), 'n_total', count(*) FROM latest GROUP BY account_id
 UNION ALL SELECT coalesce(account_id, '<null>'), 'latest_total', max(ts) FROM latest GROUP BY account_id
 UNION ALL SELECT '<listed>', prefix || {_SLUG}, NULL FROM detector_rules, (VALUES ('n_'), ('latest_')) AS p(prefix))
 SELECT nullif(account_id, '<null>') AS account_id, coalesce(COLUMNS('^n_'), 0), make_timestamp(COLUMNS('^latest_')) FROM (PIVOT cells ON name USING max(v) GROUP BY account_id) WHERE account_id <> '<listed>'"""

_CELLS = """b AS (SELECT feed, site, file_no, line_no, body::JSON AS j FROM raw_messages WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
 c AS (SELECT feed, site, file_no, line_no, key AS name, value AS v, CASE WHEN type = 'VARCHAR' THEN 'text' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'ARRAY' THEN 'list'
 WHEN type = 'OBJECT' THEN 'object' WHEN type = 'NULL' THEN NULL ELSE 'number' END AS kind FROM (SELECT b.*, unnest(json_keys(j)) AS key, json_extract(j, '$."' || unnest(json_keys(j)) || '"') AS value,
 json_type(j, '$."' || unnest(json_keys(j)) || '"') AS type FROM b)),
 q AS (SELECT feed, site, file_no, row_number() OVER (PARTITION BY feed, site ORDER BY file_no) AS seq, count(*) OVER (PARTITION BY feed, site) AS last_seq
 FROM (SELECT DISTINCT feed, site, file_no FROM raw_messages))"""
_CHANGES = f"""WITH {_CELLS},
 f AS (SELECT feed, site, seq, name, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds FROM c JOIN q USING (feed, site, file_no) GROUP BY ALL),
 went AS (SELECT feed, site, x.seq + 1 AS seq, name FROM f x JOIN q USING (feed, site, seq) WHERE seq < last_seq AND NOT EXISTS (SELECT 1 FROM f y WHERE (y.feed, y.site, y.seq, y.name) = (x.feed, x.site, x.seq + 1, x.name))),
 came AS (SELECT feed, site, seq, name FROM f x WHERE seq > 1 AND NOT EXISTS (SELECT 1 FROM f y WHERE (y.feed, y.site, y.seq, y.name) = (x.feed, x.site, x.seq - 1, x.name))),
 i AS (SELECT feed, site, seq, line_no, j, coalesce(j->>'$.alertId', j->>'$.alertID', j->>'$.AlertId', j->>'$.alert_id', j->>'$.id', j->>'$.ID', j->>'$.outbox_id') AS id FROM b JOIN q USING (feed, site, file_no)),
 r AS (SELECT went.feed, went.site, went.seq, went.name, came.name AS new_name FROM went JOIN came USING (feed, site, seq)
 JOIN i x ON (x.feed, x.site, x.seq) = (went.feed, went.site, went.seq - 1) JOIN i y ON (y.feed, y.site, y.seq, y.id) = (went.feed, went.site, went.seq, x.id)
 GROUP BY ALL HAVING count(coalesce(nullif(x.j->('$."' || went.name || '"'), 'null'), nullif(y.j->('$."' || came.name || '"'), 'null'))) > 0
 AND count(*) FILTER (nullif(x.j->('$."' || went.name || '"'), 'null') IS DISTINCT FROM nullif(y.j->('$."' || came.name || '"'), 'null')) = 0),
 a AS (SELECT feed, site, seq, 'renamed' AS change_kind, name, new_name FROM r
 UNION ALL SELECT feed, site, seq, 'removed', name, '' FROM went WHERE (feed, site, seq, name) NOT IN (SELECT (feed, site, seq, name) FROM r)
 UNION ALL SELECT feed, site, seq, 'added', name, '' FROM came WHERE (feed, site, seq, name) NOT IN (SELECT (feed, site, seq, new_name) FROM r)
 UNION ALL SELECT x.feed, x.site, x.seq, 'retyped', x.name, '' FROM f x JOIN f y ON (y.feed, y.site, y.seq, y.name) = (x.feed, x.site, x.seq - 1, x.name) WHERE len(x.kinds) > 0 AND len(y.kinds) > 0 AND x.kinds <> y.kinds)
 SELECT feed, site, file_no, change_kind, name AS field_name, new_name FROM a JOIN q USING (feed, site, seq)"""
_SPANS = f"""WITH {_CELLS}, k AS (SELECT DISTINCT feed, site, seq, name, kind FROM c JOIN q USING (feed, site, file_no) WHERE kind IS NOT NULL),
 g AS (SELECT *, seq - row_number() OVER (PARTITION BY feed, site, name, kind ORDER BY seq) AS island FROM k)
 SELECT feed, site, name AS field_name, kind, min(seq) AS first_seq, max(seq) AS last_seq FROM g GROUP BY feed, site, name, kind, island"""

SQL = {
    "p3_found": _CHANGES,
    "p3_lifespans": _SPANS,
    "p1_found": f"""WITH r AS ({_ACCOUNTS}), n AS (SELECT table_name, account_id, count(*) AS n FROM r GROUP BY ALL),
 t AS (SELECT table_name, count(*) AS total FROM r GROUP BY ALL)
 SELECT table_name, account_id FROM n JOIN t USING (table_name) WHERE n * 100 >= total AND account_id IS NOT NULL""",
    "p1_account_totals": f"""SELECT table_name, account_id, count(*) AS n_rows, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
 count(DISTINCT alert) AS n_ids FROM ({_ACCOUNTS}) GROUP BY table_name, account_id""",
    "p2_found": f"SELECT table_name, row_id, lateness FROM ({_LATE}) WHERE lateness <> 'on_time'",
    "p2_hourly_counts": f"""WITH l AS ({_LATE}), last AS (SELECT table_name, max(p) AS top, max(a) AS last_a FROM l GROUP BY ALL),
 fin AS (SELECT table_name, e, min(e) AS x FROM l GROUP BY ALL)
 SELECT table_name, e - 3600000000 AS period_us, count(*) FILTER (lateness = 'on_time') AS provisional,
 count(*) FILTER (lateness <> 'too_late') AS n, count(*) FILTER (lateness = 'corrects') AS corrections, count(*) FILTER (lateness = 'too_late') AS refused,
 CASE WHEN any_value(top) >= e + 21600000000 THEN 'frozen' WHEN any_value(top) >= e THEN 'closed' ELSE 'open' END AS state
 FROM l JOIN last USING (table_name) GROUP BY table_name, e""",
    "p4_found": _REPEATED,
    "p5_features": _WIDE,
    "p5_features_long": f"SELECT account_id, rule_name, count(*) AS n, max(ts) AS latest_us FROM ({_LATEST}) GROUP BY account_id, rule_name",
}
_TIMES = {"alert_messages": ("received_at", "produced_at"), "processed_alerts": ("produced_at", "acted_at"), "triaged_alerts": ("created_at", "triaged_at")}
for _name, _times in _TIMES.items():
    _utc = ", ".join(f"timezone('UTC', {t}) AS {t}" for t in _times)
    SQL[f"p4_{_name}"] = f"""SELECT * EXCLUDE (u, nth) REPLACE ({_utc}), {_HYPHENS} AS alert_uuid FROM (
 SELECT *, row_number() OVER (PARTITION BY coalesce(u, 'row ' || row_id) ORDER BY row_id) AS nth FROM (SELECT *, {_UUID} AS u FROM {_name})) WHERE nth = 1"""
