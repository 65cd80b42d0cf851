import pytest

import __spark_entry__ as entry
from tests.edge import empty_tables, odd_tables
from vigil.functions.text import attempts, instant_text, plain_number, trace_of, with_trace
from vigil.model import Thresholds
from vigil.operators import delivery, detect, folds, metrics, triage
from vigil.operators.validate import identity_faults, reply_fault
from vigil.session import small_side
from pyspark.sql import functions as F

NAMES = sorted(n for n in entry.queries() if n.startswith(("p1_", "p2_", "p3_", "p4_", "p5_")))


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    return empty_tables(spark, folder, str(tmp_path_factory.mktemp("empty")))


@pytest.fixture(scope="module")
def odd(spark, folder, tmp_path_factory):
    return odd_tables(spark, folder, str(tmp_path_factory.mktemp("odd")))


@pytest.mark.parametrize("name", NAMES)
def test_nothing_gives_nothing(spark, empty, name):
    assert entry.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_nulls_repeated_rows_and_clashing_columns(spark, odd, name):
    rows = entry.queries()[name](spark, odd).collect()
    assert name != "p1_account_totals" or any(r["account_id"] is None and r["n_rows"] == 2 for r in rows)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_attempts_of_any_length(spark):
    for text, want in ((None, 0), ("", 0), ("abc", 0), ("-1", 0), ("0007", 7), ("9" * 10, 2**31 - 2), ("1" * 60, 2**31 - 2), ("0" * 60, 0), ("12\n", 0)):
        assert one(spark, attempts(F.lit(text).cast("string")))[0] == want


def test_instants_numbers_and_traces(spark):
    times = [(0, "1970-01-01T00:00:00Z"), (1_591_056_769_001_000, "2020-06-02T00:12:49.001Z"), (1_591_056_769_000_010, "2020-06-02T00:12:49.000010Z"), (-1, "1969-12-31T23:59:59.999999Z")]
    assert [one(spark, instant_text(F.lit(us)))[0] for us, _ in times] == [t for _, t in times]
    assert one(spark, plain_number(F.lit(1e-9)), plain_number(F.lit("1E+3")), plain_number(F.lit("x")))[:] == ("0.000000001000000000", "1000.000000000000000000", None)
    parent = "00-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-01"
    none = F.array().cast(delivery.HEADERS)
    for given, state, want in ((parent, "a=b", (parent, "a=b")), (parent, " ", (parent, None)), ("broken", "a=b", (None, None)), (None, None, (None, None))):
        assert one(spark, trace_of(with_trace(none, F.lit(given).cast("string"), F.lit(state).cast("string"))))[0][:] == want


def test_identity_and_reply_faults(spark):
    assert one(spark, identity_faults(F.lit("a"), F.lit(None), F.lit(None)), identity_faults(F.lit("a"), F.lit("b"), F.lit("c")))[:] == ("account_id,rule_name", None)
    whole = ["0", "5", "42", "100.5", "250.75", "37.7749", "-122.4194", "1700000000000"]
    for cells, want in ((whole, None), (whole[:5], None), (whole[:4], "shape"), ([], "shape"), (["x", *whole[1:]], "shape"), (whole[:6], "geo"), ([*whole[:5], "nan", "0", "1"], "geo"), ([*whole[:7], "0"], "geo"), ([*whole[:7], "late"], "geo")):
        assert one(spark, reply_fault(F.array(*map(F.lit, cells)).cast("array<string>")))[0] == want


def test_terminal_paths_and_pinned_letters(spark):
    df = spark.createDataFrame([(None, True), ("tombstone", False), ("invalid", False), ("circuit-open", True), ("gate-error", True), ("new", True)], "fault string, published boolean")
    rows = delivery.terminal_path(df, F.col("fault"), F.col("published")).collect()
    assert [(r["action"], r["retries"], r["backoff_ms"], r["acked"]) for r in rows] == [
        ("ack", 0, 0, True), ("ack", 0, 0, True), ("dead-letter", 0, 0, False), ("hold", 0, 0, False), ("dead-letter", 2, 100, True), ("dead-letter", 2, 1000, True)]
    letters = delivery.dead_letters(df, F.lit("payment.alerts"), delivery.TRIAGE_DEAD_LETTERS).first()
    assert (letters["topic"], letters["partition"]) == ("payment.alerts.triage.DLT", -1)


def test_marks_are_made_once(spark):
    inbox = spark.createDataFrame([("a", "PENDING_TRIAGE"), ("b", "LLM_TRIAGED"), ("c", "PENDING_TRIAGE"), (None, "PENDING_TRIAGE")], "key string, triage_status string")
    verdicts = spark.createDataFrame([("a", "DEGRADED_RULE_BASED"), ("a", "DEGRADED_RULE_BASED"), ("b", "DEGRADED_RULE_BASED"), (None, "x")], "key string, new_status string")
    got = {r["key"]: (r["triage_status"], r["mark"]) for r in triage.mark(inbox, verdicts, "key").collect()}
    assert got == {"a": ("DEGRADED_RULE_BASED", "recorded"), "b": ("LLM_TRIAGED", "lost"), "c": ("PENDING_TRIAGE", None), None: ("PENDING_TRIAGE", None)}


def test_replies_of_tools(spark):
    reply = one(spark, triage.scoped(F.lit("a"), F.lit("a"), F.lit("x")), triage.scoped(F.lit("b"), F.lit("a"), F.lit("x")), triage.scoped(F.lit(None), F.lit("a"), F.lit("x")))
    assert reply[0] == "x" and reply[1] == reply[2] == triage.ACCOUNT_MISMATCH
    none = triage.history_reply(spark.range(1), F.lit(None), F.lit(None), F.lit(None), F.lit(None)).first()["reply"]
    assert none == '{"stats":{"eventCount":"0","meanAmount":"0"},"lastLocationTimestampMs":null,"recentEventIdsInWindow":[]}'


def test_quantiles_from_buckets(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 99.0), ("c", None)], "k string, v double")
    buckets = metrics.histogram(df, ["k"], F.col("v"), [2.0, 10.0])
    assert {(r["k"], r["le"]): r["n"] for r in buckets.collect()} == {("a", 2.0): 2, ("a", 10.0): 4, ("a", float("inf")): 4, ("b", 2.0): 0, ("b", 10.0): 0, ("b", float("inf")): 1, ("c", 2.0): 0, ("c", 10.0): 0, ("c", float("inf")): 0}
    got = {r["k"]: (r["p5"], r["p75"]) for r in metrics.histogram_quantiles(buckets, ["k"], (0.5, 0.75)).collect()}
    assert got == {"a": (2.0, 6.0), "b": (10.0, 10.0), "c": (None, None)}


def test_counters_that_start_anew(spark):
    rows = [("a", t, v) for t, v in ((0, 5), (10, 9), (70, 2), (80, 2), (130, 7), (131, None), (None, 9))] + [(None, 5, 5)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint").withColumn("at", F.timestamp_seconds("t"))
    got = {r["window_us"] // 10**6: (r["increase"], round(r["per_second"], 6)) for r in metrics.counter_increase(df, "at", ["at"], "v", ["k"], "1 minute").collect()}
    assert got == {0: (4, 0.066667), 60: (2, 0.033333), 120: (5, 0.083333)}


def test_throttled_events_wait_their_turn(spark):
    rows = [(str(i), "a", 0, i, 2) for i in range(5)] + [("x", "z", 0, 0, 0), ("y", "z", 1000, 1, 0)]
    df = spark.createDataFrame(rows, "event_id string, account_id string, ms bigint, arrival int, rate bigint")
    got = {r["event_id"]: (r["admitted"], r["delay_ms"]) for r in folds.throttle(df, 60_000).collect()}
    assert got == {"0": (True, 0), "1": (True, 0), "2": (True, 500), "3": (True, 1000), "4": (True, 1500), "x": (False, 5000), "y": (False, 9000)}


def test_hot_keys_are_cut_and_give_the_same(spark):
    import random

    r = random.Random(4)
    rows = [(r.choice("hhhhab"), r.choice("hhhab"), r.randrange(0, 60_000_000), i, 3) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id string, account_id string, ms bigint, arrival int, rate bigint")
    for fold, ttl in ((folds.dedup_ttl, 40_000), (folds.token_bucket, 60_000)):
        assert sorted(map(tuple, fold(df, ttl, 50).collect())) == sorted(map(tuple, fold(df, ttl).collect()))


def test_many_free_events_equal_one_by_one(spark):
    import random

    r, ms, rows = random.Random(9), 0, []
    for i in range(2000):
        ms += r.choice([0, 100, 150, 200]) if i % 400 else 5000
        rows.append((str(i), "a", ms, i, 8))
    df = spark.createDataFrame(rows, "event_id string, account_id string, ms bigint, arrival int, rate bigint")
    got = {x["event_id"]: (x["allowed"], x["wait_ms"]) for x in folds.token_bucket(df, 60_000).collect()}
    tokens, at, want = None, None, {}
    for e, _, ms, _, rate in rows:
        tokens = 8.0 if at is None or ms - at > 60_000 else min(8.0, tokens + (ms - at) / 1000.0 * rate)
        want[e] = tokens >= 1
        tokens, at = tokens - 1 if tokens >= 1 else tokens, ms
    assert {e: a for e, (a, _) in got.items()} == want


def test_flags_of_accounts(spark):
    events = spark.createDataFrame([("a",), ("b",), (None,)], "account_id string")
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "account_id string")
    got = {r["account_id"]: (r["exempt"], r["elevated"]) for r in detect.account_flags(events, of("a", "a", None), of("a", "c")).collect()}
    assert got == {"a": (True, True), "b": (False, False), None: (False, False)}


def test_alert_of_an_event_keeps_its_trace(spark):
    df = spark.createDataFrame([("0", "a", 1.0, 0.0, 0.0, 0, 0, "p"), ("1", "a", 1.0, 50.0, 50.0, 1, 1000, None)], "event_id string, account_id string, amount double, lat double, lon double, ms bigint, produced_us bigint, parent string")
    fired = detect.alerts(detect.judge(df, Thresholds()), Thresholds(), keep=("parent",))
    row = detect.outbox_rows(fired, F.lit(0).cast("timestamp"), F.struct(F.col("parent").alias("traceparent"), F.lit("s").alias("tracestate"))).first()
    assert (row["status"], row["attempts"], row["traceparent"], row["tracestate"]) == ("PENDING", 0, None, "s")
    assert '"ruleName":"geo"' in row["payload"] and '"producedAt":"1970-01-01T00:00:00.001Z"' in row["payload"]


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    wide = spark.range(50).select(F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(wide, "w")) and not hinted(small_side(wide, "w", rows=49)) and not hinted(small_side(wide, "w", most_bytes=40_000))


def test_outcomes_and_percentiles_with_hot_keys(spark):
    rows = [("h", "r1", 5), ("h", "r2", 1), ("h", "r2", 2), ("x", None, 3), (None, "r1", 4), ("y", "r1", 6)]
    df = spark.createDataFrame(rows, "k string, rule string, row bigint")
    assert {(r["rule"], r["outcome"]): r["n"] for r in metrics.outcome_counts(df, "k", "rule", "row").collect()} == {("r2", "actioned"): 1, ("r2", "duplicate"): 1, ("r1", "duplicate"): 1, (None, "actioned"): 1, ("r1", "actioned"): 1}
    values = spark.createDataFrame([("a", v) for v in range(1, 101)] + [("b", None), ("c", -7), (None, 3), (None, 4), (None, None)], "k string, v bigint")
    got = {r["k"]: tuple(r[1:]) for r in metrics.exact_percentiles(values, ["k"], F.col("v"), 7).collect()}
    assert got == {"a": (100, 50, 95, 99), "b": (0, None, None, None), "c": (1, -7, -7, -7), None: (2, 3, 4, 4)}
