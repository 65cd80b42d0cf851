import random

from pyspark.sql import functions as F

from vigil.operators import lateness as L
from vigil.session import work_path

H = L.HOUR_US
LOG = "stream string, row_id bigint, at bigint, arrival_us bigint"


def brute(rows):
    out = {}
    for s, i, p, a in rows:
        clock = max((q for t, _, q, b in rows if t == s and b < a), default=None)
        end = p - p % H + H
        out[i] = "on_time" if clock is None or clock < end else "too_late" if clock >= end + 6 * H else "corrects"
    return out


def make(seed, n=400):
    r = random.Random(seed)
    rows, t = [], 100 * H
    for i in range(n):
        t += r.choice([0, 0, 1, H // 10, H // 3])
        late = r.choice([0, 0, 0, H // 2, H, 3 * H, 7 * H, 9 * H, -H])
        at = t - late
        rows.append((r.choice("ab"), i, at - at % H if r.random() < 0.3 else at, t))
    return rows


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG).select("stream", "row_id", L.period_of(F.col("at")).alias("period_us"), "arrival_us")


def test_lateness_equals_definition(spark):
    for seed in range(3):
        rows = make(seed)
        random.Random(seed).shuffle(rows)
        got = {r["row_id"]: r["lateness"] for r in L.with_lateness(log_of(spark, rows)).collect()}
        assert got == brute(rows)


def test_period_of_times_before_1970(spark):
    assert spark.range(1).select(L.period_of(F.lit(-1))).first()[0] == -H


def test_null_times_count_for_nothing_and_empty(spark):
    df = spark.sql("SELECT 1L AS row_id, timestamp'2020-01-01 00:10:00' AS p, CAST(null AS timestamp) AS a, 'x' AS stream UNION ALL SELECT 2L, null, timestamp'2020-01-01 00:10:00', 'x'")
    assert L.event_log(df, "s", "p", "a", "row_id").count() == 0
    assert L.lambda_view(L.event_log(df, "s", "p", "a", "row_id")).collect() == []


def test_view_adds_up(spark):
    rows = make(7)
    view = L.lambda_view(log_of(spark, rows)).collect()
    want = brute(rows)
    assert sum(r["provisional"] for r in view) == sum(v == "on_time" for v in want.values())
    assert sum(r["n"] for r in view) == sum(v != "too_late" for v in want.values())
    assert sum(r["refused"] for r in view) == sum(v == "too_late" for v in want.values())


def test_layers_batch_by_batch_equal_one_pass(spark):
    rows = make(11, 240)
    views = L.LambdaViews(spark, work_path(spark, "views"))
    cuts = sorted({r[3] for r in rows})
    size = len(cuts) // 4 + 1
    for i in range(0, len(cuts), size):
        part = [r for r in rows if r[3] in set(cuts[i : i + size])]
        views.add(log_of(spark, part).drop("row_id"))
        before = {(r["stream"], r["period_us"]): r["n"] for r in views.view().collect()}
        assert before
        if i != size:
            views.recompute()
    views.recompute()
    got = {(r["stream"], r["period_us"]): r["n"] for r in views.view().collect()}
    once = {(r["stream"], r["period_us"]): r["n"] for r in L.lambda_view(log_of(spark, rows)).collect()}
    assert got == once
    assert any(r["state"] == "frozen" for r in views.view().collect())


def test_layers_stopped_and_reopened_between_batches(spark):
    rows, path = make(13, 300), work_path(spark, "views")
    cuts = sorted({r[3] for r in rows})
    size, parts = len(cuts) // 5 + 1, []
    for i in range(0, len(cuts), size):
        parts.append(log_of(spark, [r for r in rows if r[3] in set(cuts[i : i + size])]))
    frozen = {}
    for i, part in enumerate(parts):
        views = L.LambdaViews(spark, path)
        assert views.numbers == list(range(i))
        views.add(part, i)
        views.add(parts[0], 0)  # a batch repeated after a restart
        if i % 2:
            L.LambdaViews(spark, path).recompute()
        now = {(r["stream"], r["period_us"]): r for r in L.LambdaViews(spark, path).view().collect()}
        assert all(now[k]["n"] == n for k, n in frozen.items())  # frozen periods are not touched
        if i % 2:
            frozen = {k: r["n"] for k, r in now.items() if r["state"] == "frozen"}
    last = L.LambdaViews(spark, path)
    last.recompute()
    assert last.log().count() == len(rows) and frozen
    assert {r["row_id"]: r["lateness"] for r in last.log().collect()} == brute(rows)
    assert sorted(map(tuple, last.view().collect())) == sorted(tuple(r) for r in L.lambda_view(log_of(spark, rows)).select(*last.view().columns).collect())


def test_a_batch_that_broke_off_is_written_anew_and_order_is_kept(spark):
    import pytest

    rows, path = make(14, 60), work_path(spark, "views")
    views = L.LambdaViews(spark, path)
    views.add(log_of(spark, rows[:30]), 4)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log-4/_SUCCESS")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, False)
    again = L.LambdaViews(spark, path)
    assert again.numbers == []
    again.add(log_of(spark, rows[:30]), 4)
    with pytest.raises(ValueError):
        again.add(log_of(spark, rows[30:]), 3)
    assert again.log().count() == 30


def test_open_rows_alone_are_read_again(spark):
    rows = make(15, 300)
    views = L.add_in_waves(L.LambdaViews(spark, work_path(spark, "views")), log_of(spark, rows), 4, 2)
    left = spark.read.parquet(f"{views.path}/open-{views.generation}").count()
    assert views.generation == 2 and 0 < left < len(rows) / 2
    assert {r["row_id"]: r["lateness"] for r in views.log().collect()} == brute(rows)


def test_cutoff_must_fit(spark):
    import pytest

    with pytest.raises(ValueError):
        L.period_bounds(L.first_arrivals(log_of(spark, make(1))), H, H // 2)
