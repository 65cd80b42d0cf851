import json

from pyspark.sql import functions as F

from tests.brute import changes
from vigil.operators import drift

RAW = "feed string, site string, file_no int, line_no int, landed_at timestamp, body string"
U = [f"{i:08x}-abcd-5000-8000-000000000000" for i in range(50)]


def raw(spark, files, feed="payment_alert", site="s"):
    rows = [(feed, site, no, i, None, b if isinstance(b, str) or b is None else json.dumps(b)) for no, bodies in files for i, b in enumerate(bodies, 1)]
    return spark.createDataFrame(rows, RAW)


def both(spark, df):
    got = [tuple(r) for r in drift.schema_changes(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == changes([(r["feed"], r["site"], r["file_no"], r["body"]) for r in df.collect()])
    return {x[2:] for x in got}


def test_every_kind_of_change(spark):
    df = raw(spark, [
        (1, [{"alertId": U[0], "reason": "a", "n": 1, "b": True}, {"alertId": U[1], "reason": None, "n": 2}, "NOT JSON", "", None, "[1]", '{"a":']),
        (4, [{"alert_id": U[0].upper(), "why": "a", "n": "1", "B": True}, {"alert_id": U[2], "why": "x", "n": "3"}]),
        (7, [{"alert_id": U[0], "why": {"code": "a"}, "n": None}, {"alert_id": U[3], "extra": [1]}]),
        (9, [{"alert_id": U[3], "n": 5, "extra": {"k": 1}}]),
    ])
    got = both(spark, df)
    assert (4, "renamed", "reason", "why") in got and (4, "renamed", "b", "B") in got and (4, "retyped", "n", "") in got
    assert (4, "removed", "alertId", "") in got and (4, "added", "alert_id", "") in got  # written in another case: not equal
    assert (7, "retyped", "why", "") in got and not any(x[2] == "n" and x[0] in (7, 9) for x in got)


def test_values_that_disagree_once_are_no_rename(spark):
    df = raw(spark, [(1, [{"alertId": U[i], "x": i} for i in range(5)]), (2, [{"alertId": U[i], "y": i if i != 3 else 9} for i in range(5)])])
    assert both(spark, df) == {(2, "removed", "x", ""), (2, "added", "y", "")}


def test_a_value_against_null_is_no_rename_and_equal_objects_are(spark):
    df = raw(spark, [
        (1, [{"alertId": U[0], "x": {"a": 1, "b": [1.50]}, "p": 1}, {"alertId": U[1], "x": None, "p": None}]),
        (2, [{"alertId": U[0], "y": {"b": [1.5], "a": 1}, "q": 1}, {"alertId": U[1], "q": 3}]),
    ])
    assert both(spark, df) == {(2, "renamed", "x", "y"), (2, "removed", "p", ""), (2, "added", "q", "")}


def test_file_without_objects_and_one_file_and_no_lines(spark):
    assert both(spark, raw(spark, [(1, [{"alertId": U[0]}]), (2, ["x", None]), (3, [{"alertId": U[0]}])])) == {(2, "removed", "alertId", ""), (3, "added", "alertId", "")}
    assert both(spark, raw(spark, [(1, [{"alertId": U[0]}])])) == set()
    assert drift.schema_changes(spark.createDataFrame([], RAW)).collect() == []


def test_hot_site_among_others(spark):
    files = [(no, [{"id": U[i], ("status" if no % 2 else "state"): "P", "attempts": i if no < 3 else str(i)} for i in range(20)]) for no in range(1, 6)]
    df = raw(spark, files, "outbox_row", "hot").unionByName(raw(spark, [(1, [{"id": U[0]}])], "outbox_row", "cold"))
    assert (3, "retyped", "attempts", "") in both(spark, df)


def test_test_data(spark, folder):
    from vigil.sources.tables import table

    both(spark, table(spark, folder, "raw_messages"))


def test_unified_casts_every_form(spark):
    bodies = [
        {"id": U[0].upper(), "payload": {"b": 1}, "attempts": "3", "createdAt": 1591261929001, "traceparent": {"traceId": "t", "spanId": "s", "flags": "01"}},
        {"outbox_id": U[1], "body": '{"b":1}', "tries": 4, "created_at": "2020-06-03T12:31:31.476610Z", "w3c_parent": ["00", "t", "s", "00"], "new": [1]},
        {"ID": "?", "attempts": "x", "created_at": "never", "traceParent": "00-t-s-01", "status": {"code": "P"}},
        {},
    ]
    rows = drift.unified(raw(spark, [(1, [*bodies, "{", None])], "outbox_row"), "outbox_row").orderBy("line_no").collect()
    assert [r["id"] for r in rows] == [U[0], U[1], "?", None]
    assert [r["payload"] for r in rows] == ['{"b":1}', '{"b":1}', None, None]
    assert [r["attempts"] for r in rows] == [3, 4, None, None]
    assert [str(r["created_at"]) for r in rows] == ["2020-06-04 09:12:09.001000", "2020-06-03 12:31:31.476610", "None", "None"]
    assert [r["traceparent"] for r in rows] == ["00-t-s-01", "00-t-s-00", "00-t-s-01", None]
    assert rows[2]["status"] == "P" and rows[1]["extra"] == {"new": "[1]"} and rows[3]["extra"] == {}


def test_every_renamed_field_of_the_data_has_one_canonical_column(spark, folder):
    from vigil.sources.tables import table

    home = {(feed, name): column for feed, column, _, names in drift.ALIASES for name in names}
    for r in drift.schema_changes(table(spark, folder, "raw_messages")).filter(F.col("change_kind") == "renamed").collect():
        assert home.get((r["feed"], r["field_name"])) == home.get((r["feed"], r["new_name"]))


def test_no_value_is_lost(spark):
    body = {"id": U[0], "created_at": 1700000000000001, "status": "P", "state": "Q", "attempts": "many", "account_id": {"code": "a", "region": "x"}, "tracestate": {"code": "only"}, "unknown": "1", "list": [1, "1"]}
    other = {"id": U[1], "created_at": 1700000000000000001, "attempts": 3.5, "acct": None, "traceparent": ["00", "t", "s", "00", "more"], "none": None}
    third = {"id": U[2], "created_at": 1700000000, "inserted_at": "2020-01-01T00:00:00Z"}
    rows = drift.unified(raw(spark, [(1, [body, other, third, '{"a":1'])], "outbox_row"), "outbox_row").orderBy("line_no").collect()
    assert [str(r["created_at"]) for r in rows] == ["2023-11-14 22:13:20.000001", "None", "2023-11-14 22:13:20"]
    assert rows[0]["status"] == "P" and rows[0]["account_id"] == "a" and rows[0]["tracestate"] == "only"
    assert {k: json.loads(v) for k, v in rows[0]["extra"].items()} == {k: body[k] for k in ("state", "attempts", "account_id", "unknown", "list")}
    assert {k: json.loads(v) for k, v in rows[1]["extra"].items()} == {k: other[k] for k in ("created_at", "attempts", "traceparent", "none")}
    assert {k: json.loads(v) for k, v in rows[2]["extra"].items()} == {"inserted_at": third["inserted_at"]}


def test_renames_extend_the_alias_table(spark):
    changes = spark.createDataFrame(
        [("outbox_row", "renamed", "status", "phase"), ("outbox_row", "renamed", "phase", "lane"), ("outbox_row", "renamed", "lane", "phase"), ("outbox_row", "renamed", "x", "y"),
         ("outbox_row", "renamed", "tries", "both"), ("outbox_row", "renamed", "state", "both"), ("payment_alert", "renamed", "status", "other"), ("outbox_row", "added", "status", "")],
        "feed string, change_kind string, field_name string, new_name string",
    )
    table = {column: names for feed, column, _, names in drift.with_renames(changes, "outbox_row") if feed == "outbox_row"}
    assert table["status"] == ["status", "state", "lane", "phase"] and "both" not in table["attempts"] + table["status"]
    bodies = raw(spark, [(1, [{"id": U[0], "status": "A"}]), (2, [{"id": U[0], "phase": "A"}]), (3, [{"id": U[1], "phase": "B", "more": 1}])], "outbox_row")
    out = drift.unified(bodies, "outbox_row", drift.with_renames(drift.schema_changes(bodies), "outbox_row")).orderBy("file_no").collect()
    assert [(r["status"], dict(r["extra"])) for r in out] == [("A", {}), ("A", {}), ("B", {"more": "1"})]
