import random

from vigil.operators import folds

EVENTS = "event_id string, account_id string, ms bigint, arrival int, amount double, rate bigint"


def make(spark, rows):
    return spark.createDataFrame([(str(e), str(a), ms, i, float(x), rate) for i, (e, a, ms, x, rate) in enumerate(rows)], EVENTS)


def test_dedup_bounds_and_no_prolonging(spark):
    df = make(spark, [(1, "a", 0, 0, 1), (1, "a", 299_999, 0, 1), (1, "b", 300_000, 0, 1), (1, "a", 599_999, 0, 1), (2, "a", 5, 0, 1)])
    got = {(r["event_id"], r["ms"]): r["accepted"] for r in folds.dedup_ttl(df, 300_000).collect()}
    assert got == {("1", 0): True, ("1", 299_999): False, ("1", 300_000): True, ("1", 599_999): False, ("2", 5): True}


def test_dedup_equals_plain_fold(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, 3]), "a", r.randrange(4000), 0, 1) for _ in range(400)]
    last, want = {}, {}
    for e, _, ms, *_ , i in sorted([(*x, i) for i, x in enumerate(rows)], key=lambda x: (x[2], x[-1])):
        want[i] = e not in last or ms - last[e] >= 100
        if want[i]:
            last[e] = ms
    assert {x["arrival"]: x["accepted"] for x in folds.dedup_ttl(make(spark, rows), 100).collect()} == want


def test_token_bucket_equals_plain_fold(spark):
    r = random.Random(6)
    rows, t = [], 0
    for i in range(500):
        t += r.choice([0, 0, 10, 50, 200, 999, 1000, 70_000] if r.random() < 0.2 else [0, 5, 30])
        rows.append((i, r.choice("aab"), t, 0, 5))
    state, want = {}, {}
    for e, a, ms, _, rate in rows:
        tokens, at = state.get(a, (None, None))
        tokens = float(rate) if tokens is None or ms - at > 60_000 else min(float(rate), tokens + (ms - at) / 1000 * rate)
        want[str(e)] = tokens >= 1
        state[a] = (tokens - 1 if tokens >= 1 else tokens, ms)
    got = folds.token_bucket(make(spark, rows), 60_000).collect()
    assert {x["event_id"]: x["allowed"] for x in got} == want
    assert all((x["wait_ms"] > 0) != x["allowed"] for x in got)


def test_rates_and_zero_rate(spark):
    got = folds.token_bucket(make(spark, [(i, "a", 0, 0, 5) for i in range(50)] + [(100, "z", 0, 0, 0)]), 60_000).collect()
    assert sum(x["allowed"] for x in got) == 5 and next(x for x in got if x["event_id"] == "100")["wait_ms"] == -1


def test_capped_welford_bound_and_blocks(spark):
    df = make(spark, [(f"{i:03}", "a", i * 1000, 110 if i % 2 else 90, 1) for i in range(500)])
    for block in (7_000, 10**9):
        rows = folds.capped_welford(df, 50, block).orderBy("n").collect()
        assert rows[-1]["n"] == 500 and 0 < rows[-1]["m2"] < 15_000
        n, mean, m2 = 0, 0.0, 0.0
        for i, row in enumerate(rows):
            x = 110 if i % 2 else 90
            n += 1
            d = x - mean
            mean += d / min(n, 50)
            m2 = (m2 - m2 / 50 if n > 50 else m2) + d * (x - mean)
            assert abs(row["mean"] - mean) < 1e-9 and abs(row["m2"] - m2) < 1e-6


def test_capped_welford_with_equal_and_with_large_amounts(spark):
    flat = make(spark, [(f"{i:03}", "a", i * 1000, 0.1, None) for i in range(100)])
    rows = folds.capped_welford(flat, 20, 7_000).collect()
    assert all(r["m2"] == 0 and r["rate"] is None for r in rows) and len(rows) == 100
    large = make(spark, [(f"{i:03}", "a", i * 1000, 1e9 + i % 2 / 10, 2**60 + 1) for i in range(400)])
    last = folds.capped_welford(large, 50, 7_000).orderBy("n").collect()[-1]
    assert abs(last["m2"] / 50 - 0.0025) < 1e-4 and last["rate"] == 2**60 + 1


def test_empty(spark):
    empty = make(spark, [])
    assert folds.dedup_ttl(empty, 1).collect() == folds.token_bucket(empty, 1).collect() == folds.capped_welford(empty, 5).collect() == []
