import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.geo import haversine_km, speed_kmh
from vigil.functions.text import attempts, header_text, is_traceparent, mask, with_header, without_headers
from vigil.model import MS_PER_HOUR, Thresholds
from vigil.operators import detect as D
from vigil.operators.running import prior_in_window, running
from vigil.operators.validate import decode, event_violations, location_fault, parse_verdict, split, verdict_faults

EVENTS = "event_id string, account_id string, amount double, lat double, lon double, ms bigint, produced_us bigint"
ONE = "n bigint, mean double, m2 double, amount double, velocity_prior bigint, speed_kmh double, prev struct<lat:double,lon:double,ms:bigint>, ms bigint"


def events(spark, rows):
    return spark.createDataFrame([(str(i), a, float(x), float(lat), float(lon), ms, ms * 1000) for i, (a, x, lat, lon, ms) in enumerate(rows)], EVENTS)


def test_velocity_bounds(spark):
    df = events(spark, [("a", 1, 0, 0, t) for t in (0, 1, 60_000, 60_000, 60_001, 120_000)])
    got = [r["velocity_prior"] for r in D.velocity(df, 60_000).orderBy("event_id").collect()]
    assert got == [0, 1, 1, 2, 2, 1]  # an event exactly the window old does not count; at the same time the earlier id does


def test_velocity_equals_one_window_with_hot_account_and_ties(spark):
    r = random.Random(3)
    df = events(spark, [(r.choice("aaaab"), 1, 0, 0, r.randrange(2000)) for _ in range(600)]).withColumn("__stretchy", F.lit(1))
    plain = F.count(F.lit(1)).over(W.partitionBy("account_id").orderBy("ms").rangeBetween(-99, -1)) + F.row_number().over(W.partitionBy("account_id", "ms").orderBy("event_id")) - 1
    out = prior_in_window(df, "account_id", "ms", "event_id", 100).withColumn("want", plain)
    assert out.filter("prior != want").count() == 0 and out.count() == 600


def test_running_equals_one_window(spark):
    r = random.Random(4)
    df = events(spark, [(r.choice("aaab"), r.randrange(100), i, 0, r.randrange(5000)) for i in range(500)]).withColumn("b", F.floor(F.col("ms") / 300)).withColumn("x", F.when(F.col("amount") > 20, F.col("amount")))
    w = W.partitionBy("account_id").orderBy("ms", "event_id")
    out = running(df, ["account_id"], "b", ["ms", "event_id"], {"s": "x"}, {"lo": "x"}, {"hi": "x"}, {"p": ["lat", "ms"]})
    checks = [("s", F.sum("x")), ("lo", F.min("x")), ("hi", F.max("x"))]
    for name, agg in checks:
        out = out.withColumn(f"w_{name}", agg.over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("w_p", F.lag(F.struct("lat", "ms")).over(w))
    for name in ("s", "lo", "hi", "p"):
        assert out.filter(~F.col(name).eqNullSafe(F.col(f"w_{name}"))).count() == 0


def test_statistics_replace_columns_of_the_same_name_and_flat_amounts_have_no_deviation(spark):
    df = events(spark, [("a", 0.1, 0, 0, i * 86_400_000) for i in range(40)]).withColumn("n", F.lit("clash"))
    rows = D.statistics(df).collect()
    assert all(r["m2"] == 0 for r in rows) and sorted(r["n"] for r in rows) == list(range(1, 41))


@pytest.mark.parametrize(
    ("n", "mean", "m2", "x", "reason"),
    [(29, 50, 1000, 500, "zscore:insufficient-history"), (30, 50, 30, 50, "zscore:ok"), (50, 100, 0, 100, "zscore:stddev=0,all-amounts-identical"), (100, 100, 400, 200, None), (100, 100, 400, 103, "zscore:ok"), (10**6, 100, 40_000, 103, "zscore:ok"), (10**6, 100, 40_000, 200, None)],
)
def test_zscore_cases(spark, n, mean, m2, x, reason):
    df = spark.createDataFrame([(n, float(mean), float(m2), float(x), 0, None, None, 0)], ONE)
    assert df.select(D.clean_reason("zscore", Thresholds()), D.zscore_fires(Thresholds())).first()[:] == (reason, reason is None)


@pytest.mark.parametrize(("prior", "fires"), [(2, False), (3, True), (10, True)])
def test_velocity_cases(spark, prior, fires):
    df = spark.createDataFrame([(1, 1.0, 0.0, 1.0, prior, None, None, 0)], ONE)
    t = Thresholds(velocity_max=3)
    assert df.select(D.velocity_fires(t), D.clean_reason("velocity", t)).first()[:] == (fires, None if fires else "velocity:ok")


@pytest.mark.parametrize(
    ("prev", "now", "delta", "reason"),
    [((37.7749, -122.4194), (40.7128, -74.0060), 60_000, None), ((37, -122), (38, -122), 2 * MS_PER_HOUR, "geo:ok"), ((37, -122), (40, -74), 0, "geo:non-positive-time-delta"), (None, (40, -74), 0, "geo:no-prior-location")],
)
def test_geo_cases(spark, prev, now, delta, reason):
    rows = ([("a", 1, *prev, 1000)] if prev else []) + [("a", 1, *now, 1000 + delta)]
    last = D.movement(events(spark, rows), 10**9).orderBy(F.col("event_id").desc()).select(D.clean_reason("geo", Thresholds())).first()[0]
    assert last == reason
    assert D.movement(events(spark, rows), 10**9).select(D.clean_reason("geo", Thresholds(), F.lit(True))).first()[0] == "geo:exempt"


def test_distance_and_expiry(spark):
    assert spark.range(1).select(F.round(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), 6)).first()[0] == 20015.086796
    assert spark.range(1).select(speed_kmh(F.lit(1.0), F.lit(0))).first()[0] is None
    df = events(spark, [("a", 1, 0, 0, 0), ("a", 1, 1, 1, 100), ("a", 1, 1, 1, 201)])
    assert [r["prev"] is None for r in D.movement(df, 100).orderBy("ms").collect()] == [True, False, True]


def test_precedence_and_one_alert_per_event(spark):
    df = events(spark, [("a", 1, 0, 0, 0), ("a", 1, 50, 50, 1), ("a", 1, -50, 50, 2), ("b", 1, 0, 0, 0), ("b", 1, 80, 0, 5_000)])
    t = Thresholds(velocity_max=2, velocity_window_ms=1000)
    got = {r["event_id"]: (r["rule_name"], r["reason"]) for r in D.alerts(D.judge(df, t), t).collect()}
    assert got["2"] == ("velocity", "2 events in window (max=2)") and got["1"][0] == "geo" and got["4"][0] == "geo" and len(got) == 3


def test_a_rule_of_ones_own_comes_last(spark):
    df = events(spark, [("a", 1, 0, 0, 0), ("a", 99, 50, 50, 1), ("b", 99, 0, 0, 0)])
    large = ("large", F.col("amount") > 50, F.format_string("amount=%.1f", "amount"))
    got = {r["event_id"]: (r["rule_name"], r["reason"]) for r in D.alerts(D.judge(df, Thresholds()), Thresholds(), more=[large]).collect()}
    assert got["1"][0] == "geo" and got["2"] == ("large", "amount=99.0") and len(got) == 2


def test_hot_account_far_above_the_cap_equals_the_recurrence(spark, tmp_path):
    from vigil.plans.reference import QUERIES, T

    r, n, mean, m2, want = random.Random(12), 0, 0.0, 0.0, {}
    amounts = [r.gauss(1000, 50) if i < 15_000 else 1000.0 + (30 if i % 1000 == 999 else r.gauss(0, 2)) for i in range(60_000)]
    for i, x in enumerate(amounts):
        n += 1
        d = x - mean
        mean += d / min(n, T.zscore_cap)
        m2 = (m2 - m2 / T.zscore_cap if n > T.zscore_cap else m2) + d * (x - mean)
        z = abs(x - mean) / (m2 / min(n, T.zscore_cap)) ** 0.5 if m2 else 0
        if n >= T.zscore_min_count and z > T.zscore_threshold:
            want[i] = z
    ids = spark.createDataFrame(list(enumerate(amounts)), "event_id bigint, value double")
    ids.selectExpr("event_id", "7 AS user_id", "value", "timestamp_millis(1700000000000 + event_id * 40000) AS ts", "'{\"k\": 1}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(50).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {int(x["event_id"]): x["z"] for x in QUERIES["zscore_alerts"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[i] - z) < 1e-3 for i, z in want.items())
    assert set(range(50_999, 60_000, 1000)) <= set(want)  # the first regime has decayed by then
    assert {int(x["event_id"]) for x in QUERIES["alert_reasons"](spark, str(tmp_path)).filter("rule_name = 'zscore'").collect()} <= set(want)
    judged = D.judge(events(spark, [("a", x, 0, 0, i * 40_000) for i, x in enumerate(amounts)]), Thresholds())
    assert {int(x["event_id"]) for x in judged.filter(D.zscore_fires(Thresholds())).collect()} == set(want)


def test_judging_blocks_copies_and_restarts_after_a_pause(spark):
    r, ms, rows = random.Random(5), 0, []
    for i in range(300):
        ms += 2000 if i in (100, 200) else r.randrange(1, 60)
        rows.append((f"{i - r.choice([1, 2]) if i % 7 == 6 else i:03}", "a", float(r.randrange(100)), 0.0, 0.0, ms, ms * 1000))
    t, last, want, at, n, mean, m2 = Thresholds(dedup_ttl_ms=70, stats_ttl_ms=1000, zscore_cap=40), {}, {}, None, 0, 0.0, 0.0
    for e, _, x, _, _, ms, _ in rows:
        if e in last and ms - last[e] < t.dedup_ttl_ms:
            continue
        if at is not None and ms - at > t.stats_ttl_ms:
            n, mean, m2 = 0, 0.0, 0.0
        last[e], at, n = ms, ms, n + 1
        d = x - mean
        mean += d / min(n, t.zscore_cap)
        m2 = (m2 - m2 / t.zscore_cap if n > t.zscore_cap else m2) + d * (x - mean)
        want[e, ms] = n, mean, m2
    assert 260 < len(want) < 300
    got = {(x["event_id"], x["ms"]): x for x in D.judge(spark.createDataFrame(rows, EVENTS), t).collect()}
    assert set(got) == set(want)
    assert all(got[k]["n"] == n and abs(got[k]["mean"] - mean) < 1e-9 and abs(got[k]["m2"] - m2) < 1e-6 for k, (n, mean, m2) in want.items())


@pytest.mark.parametrize("size", [60, 3000])
def test_large_amounts_that_differ_little(spark, size):
    amounts = [1e9 + (i % 2) for i in range(size)]
    df = events(spark, [("a", x, 0, 0, i * 40_000_000) for i, x in enumerate(amounts)])
    last = D.statistics(df).orderBy(F.col("ms").desc()).first()
    assert last["n"] == size and abs(last["mean"] - (1e9 + 0.5)) < 1e-6 and abs(last["m2"] / size - 0.25) < 1e-6
    capped = D.capped_welford(df, 10**6).orderBy(F.col("ms").desc()).first()
    assert abs(capped["m2"] / size - 0.25) < 1e-6


def test_statistics_with_restarts_equal_a_loop(spark):
    r, ms, rows = random.Random(6), 0, []
    for i in range(700):
        ms += r.choice([0, 5, 40, 2000 if r.random() < 0.1 else 60])
        rows.append((r.choice("aaab"), r.gauss(1e6, 3), i, 0, ms))
    got = {x["event_id"]: x for x in D.statistics(events(spark, rows), 900, 250, {"prev": ["lat", "ms"]}).collect()}
    state = {}
    for i, (a, x, lat, _, ms) in sorted(enumerate(rows), key=lambda e: (e[1][4], str(e[0]))):
        n, mean, m2, epoch, prev = state.get(a, (0, 0.0, 0.0, 0, None))
        if prev and ms - prev[1] > 900:
            n, mean, m2, epoch = 0, 0.0, 0.0, epoch + 1
        d = x - mean
        n, mean = n + 1, mean + d / (n + 1)
        m2 += d * (x - mean)
        g = got[str(i)]
        assert (g["n"], g["epoch"], g["prev"] and tuple(g["prev"])) == (n, epoch, prev)
        assert abs(g["mean"] - mean) < 1e-6 and abs(g["m2"] - m2) < 1e-5 * max(1, m2)
        state[a] = n, mean, m2, epoch, (lat, ms)


def test_plans_read_their_source_at_most_twice(spark, tmp_path):
    path = f"{tmp_path}/e"
    events(spark, [("a", i, 0, 0, i * 1000) for i in range(50)]).write.parquet(path)
    for made in (D.statistics(spark.read.parquet(path), 1000), D.movement(spark.read.parquet(path), 1000), D.velocity(spark.read.parquet(path), 1000)):
        assert made._jdf.queryExecution().executedPlan().toString().count(f"Location: InMemoryFileIndex(1 paths)[file:{path}") <= 2


def test_idle_epochs(spark):
    df = events(spark, [("a", i, 0, 0, t) for i, t in enumerate((0, 10, 111, 212, 212 + 86_400_000))])
    assert [r["epoch"] for r in D.idle_epochs(df, 100).orderBy("ms").collect()] == [0, 0, 1, 2, 3]


def test_violations(spark):
    rows = [("e", "a", 0.0, 90.0, 180.0, 1), ("", " ", -0.01, 90.01, -180.01, None), (None, None, None, None, None, None), ("e", "a", float("nan"), float("nan"), 0.0, 1)]
    df = spark.createDataFrame(rows, "e string, a string, x double, lat double, lon double, t bigint")
    assert [r[0] for r in df.select(event_violations(*[F.col(c) for c in df.columns])).collect()] == [0, 6, 6, 2]
    faults = [r[0] for r in spark.createDataFrame([(float("nan"), 999.0, 1), (91.5, 0.0, 1), (None, 1.0, 1), (None, None, None), (90.0, -180.0, 1), (0.0, 0.0, 0)], "a double, b double, c bigint").select(location_fault(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert faults == ["nan", "range", "partial", None, None, "time"]


def test_decode_keeps_poison(spark):
    df = spark.createDataFrame([('{"alertId":"x","more":1}',), ("NOT_VALID_JSON",), (None,), ("",), ("[]",)], "value string")
    out = decode(df, "value", "alertId string, schemaVersion string")
    good, bad = split(out, ~F.col("poison"))
    assert [(r["record"]["alertId"], r["record"]["schemaVersion"]) for r in good.collect()] == [("x", None)]
    assert {r["value"] for r in bad.collect()} == {"NOT_VALID_JSON", "", "[]"}


def test_verdicts(spark):
    good = '{"severity":"LOW","narrative":"n","evidence":[{"toolCallId":"c","finding":"f"}],"confidence":1.0}'
    bad = ['{"narrative":"n","evidence":[],"confidence":0.5}', good.replace('"n"', '" "'), good.replace("1.0", "1.5"), good.replace("1.0", "-0.1"), good.replace('"c"', '" "'), '{"severity":"LOW","narrative":"n","confidence":0.5}']
    rows = spark.createDataFrame([(x,) for x in [good, *bad, None]], "v string").select(verdict_faults(parse_verdict(F.col("v")))).collect()
    assert [r[0] for r in rows] == [0, 1, 1, 1, 1, 1, 1, 5]


def test_text_helpers(spark):
    h = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(F.lit(v), "UTF-8").alias("value")) for k, v in (("a", "1"), ("b", "ü"), ("a", "2"))])
    df = spark.range(1).withColumn("h", h)
    assert df.select(header_text(F.col("h"), "a"), header_text(F.col("h"), "b"), header_text(F.col("h"), "c")).first()[:] == ("2", "ü", None)
    assert df.select(F.size(without_headers(F.col("h"), ["a"])), header_text(with_header(F.col("h"), "c", F.lit("3")), "c")).first()[:] == (1, "3")
    texts = spark.createDataFrame([("12345",), ("123",), (None,)], "t string")
    assert [r[:] for r in texts.select(mask(F.col("t"), 4), attempts(F.col("t"))).collect()] == [("2345", 12345), ("****", 123), ("****", 0)]
    assert spark.range(1).select(attempts(F.lit("abc")), is_traceparent(F.lit("00-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-01")), is_traceparent(F.lit(None).cast("string"))).first()[:] == (0, True, False)
