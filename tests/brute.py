"""Brute-force forms of definitions, over lists of rows."""

import collections
import json
import re
import uuid

KINDS = {str: "text", bool: "boolean", int: "number", float: "number", list: "list", dict: "object", type(None): None}
ID_NAMES = {"payment_alert": {"alertid"}, "triaged_alert": {"alertid"}, "outbox_row": {"id", "outboxid", "alertid"}}


def canonical(text):
    if not isinstance(text, str):
        return None
    plain = re.sub(r"^urn:uuid:", "", text.strip().lower()).strip("{}").replace("-", "")
    return str(uuid.UUID(plain)) if re.fullmatch("[0-9a-f]{32}", plain) else None


def changes(rows):
    """rows: (feed, site, file_no, body) -> set of changes."""
    files, series, out = {}, collections.defaultdict(set), set()
    for feed, site, no, body in rows:
        objects = files.setdefault((feed, site, no), [])
        series[feed, site].add(no)
        try:
            found = json.loads(body)
        except (TypeError, ValueError):
            continue
        if isinstance(found, dict):
            objects.append(found)

    def ident(feed, record):
        named = [v for k, v in record.items() if k.lower().replace("_", "") in ID_NAMES[feed] and isinstance(v, str)]
        return (canonical(named[0]) or named[0]) if named else None

    for (feed, site), numbers in series.items():
        ordered = sorted(numbers)
        for a, b in zip(ordered, ordered[1:]):
            old_rows, new_rows = files[feed, site, a], files[feed, site, b]
            old_names, new_names = {k for r in old_rows for k in r}, {k for r in new_rows for k in r}
            pairs = [(x, y) for x in old_rows for y in new_rows if ident(feed, x) is not None and ident(feed, x) == ident(feed, y)]
            gone, came, moved = old_names - new_names, new_names - old_names, set()
            for x in gone:
                for y in came:
                    values = [(p.get(x), q.get(y)) for p, q in pairs if p.get(x) is not None or q.get(y) is not None]
                    if values and all(json.dumps(p, sort_keys=True) == json.dumps(q, sort_keys=True) for p, q in values):
                        moved |= {x, y}
                        out.add((feed, site, b, "renamed", x, y))
            out |= {(feed, site, b, "removed", x, "") for x in gone - moved} | {(feed, site, b, "added", y, "") for y in came - moved}
            for name in old_names & new_names:
                kinds = [{KINDS[type(r[name])] for r in some if name in r} - {None} for some in (old_rows, new_rows)]
                if all(kinds) and kinds[0] != kinds[1]:
                    out.add((feed, site, b, "retyped", name, ""))
    return out
