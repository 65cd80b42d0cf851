from pyspark.sql import functions as F

from vigil.operators import delivery, metrics, triage
from vigil.operators.validate import parse_verdict


def test_insert_if_absent(spark):
    incoming = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4)], "k string, o int").withColumn("batch", F.lit(1))
    assert {tuple(r) for r in delivery.insert_if_absent(incoming, spark.createDataFrame([("b",)], "k string"), "k", "o").collect()} == {("a", 1)}


def test_retry_budget(spark):
    df = spark.createDataFrame([("ok", "PENDING", 0), ("bad", "PENDING", 4), ("bad", "PENDING", 1), ("x", "PENDING", 5), ("x", "PUBLISHED", 1)], "id string, status string, attempts int")
    got = [r[:] for r in delivery.retry_budget(df, F.col("id") == "bad").collect()]
    assert got == [("ok", "PUBLISHED", 1), ("bad", "FAILED", 5), ("bad", "PENDING", 2), ("x", "FAILED", 5), ("x", "PUBLISHED", 1)]


def test_purge_keeps_null_times(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp'2020-01-01'), (2, timestamp'2020-01-09'), (3, null) AS t(i, at)")
    assert {r["i"] for r in delivery.purge(df, F.col("at"), F.lit("2020-01-10").cast("timestamp"), 7).collect()} == {2, 3}


def headers(**pairs):
    return F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("key"), F.encode(F.lit(v), "UTF-8").alias("value")) for k, v in pairs.items()])


def test_redrive_cases(spark):
    from vigil.functions.text import header_text

    for tries, dest in (("0", "payment.events"), ("2", "payment.events"), ("3", "payment.events.DLT.parked"), ("abc", "payment.events"), ("99999999999", "payment.events.DLT.parked"), ("0" * 50, "payment.events")):
        df = spark.range(1).select(F.lit("payment.events.DLT").alias("topic"), headers(trace="t", x_redrive_attempts=tries, x_redrive_origin="stale").alias("headers"))
        out = delivery.redrive(df, F.lit("2020-06-15 01:02:03").cast("timestamp"))
        row = out.select("dest", *[header_text(F.col("headers"), f"x-redrive-{n}") for n in ("attempts", "at", "origin")], F.size("headers")).first()
        assert row[:] == (dest, str(min(int(tries) if tries.isdigit() else 0, 2**31 - 2) + 1), "2020-06-15T01:02:03Z", "payment.events.DLT", 4)
    assert delivery.redrive(spark.range(1).select(F.lit("other").alias("topic"), headers(a="b").alias("headers"))).first()["dest"] is None


def test_reconstruction_cases(spark):
    base = spark.range(1).select(F.lit("0").alias("event_id"), F.lit("a").alias("account_id"))
    run = lambda **h: delivery.reconstruct(base.withColumn("headers", headers(**h))).select("action", "alert_id", "reason").first()[:]
    assert run(x_redrive_attempts="1", x_rpe_outcome="ALERT_UNDURABLE", x_rpe_rule="velocity") == ("emit", "cbcc1248-39de-58c4-8ce9-b356bd312041", "reconstructed-from-redrive")
    assert run(x_redrive_attempts="1") == ("dead-letter", None, None)
    assert run(trace="t") == ("ack", None, None)


def test_grounding_cases(spark):
    verdict = lambda ids, c: '{"severity":"LOW","narrative":"n","evidence":[%s],"confidence":%s}' % (",".join(f'{{"toolCallId":"{i}","finding":"f"}}' for i in ids), c)
    for ids, c, want in ((["fake"], 0.99, (0, True, 0.2)), (["real-call-1", "fake"], 0.8, (1, False, 0.8)), ([], 0.6, (0, False, 0.6))):
        df = spark.createDataFrame([(verdict(ids, c),)], "t string").withColumn("v", parse_verdict(F.col("t")))
        assert triage.ground(df, "v", F.array(F.lit("real-call-1"))).select(F.size("evidence"), "stripped", "confidence").first()[:] == want


def test_degraded_retry_tools(spark):
    df = spark.createDataFrame([("geo",), ("velocity",), ("other",), (None,)], "rule_name string")
    assert [r["severity"] for r in triage.degraded(df, "x").collect()] == ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM"]
    assert [r[0] for r in df.select(F.size(triage.tools_of(F.col("rule_name")))).collect()] == [1, 2, 1, 1]
    calls = spark.createDataFrame([(429, None), (503, None), (None, True), (400, False), (None, None)], "s int, io boolean")
    assert [r[0] for r in calls.select(triage.retryable(F.col("s"), F.col("io"))).collect()] == [True, True, True, False, False]


def test_topk_keeps_ties_in_order_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("hot", i % 7, i) for i in range(500)] + [("cold", 1, 1), (None, 1, 2)], "k string, x int, i int")
    top = delivery.latest_per_key(df, "k", [F.col("x").desc(), F.col("i")], 3)
    assert [r["i"] for r in top.filter("k = 'hot'").orderBy("rank").collect()] == [6, 13, 20] and top.count() == 5
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_metrics(spark):
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, 5), ("t", 2, 3)], "topic string, partition_no int, end_offset bigint")
    committed = spark.createDataFrame([("t", 0, 4), ("t", 1, 9)], "topic string, partition_no int, committed_offset bigint")
    assert metrics.lag(ends, committed, ["topic"]).first()["lag"] == 9
    offsets = spark.createDataFrame([("t", 0, 5), ("t", 0, 9), ("t", 1, 1)], "topic string, partition_no int, offset_no bigint")
    assert metrics.depth(offsets, ["topic"]).first()["depth"] == 6
    p = metrics.percentiles(spark.range(1, 101).withColumn("g", F.lit("g")), ["g"], F.col("id")).first()
    assert (p["n"], p["p5"], p["p95"], p["p99"]) == (100, 50, 95, 99)
