import random

from pyspark.sql import functions as F

from vigil.model import Thresholds
from vigil.operators import detect, folds
from vigil.operators.idindex import IdIndex, kept_rows
from vigil.operators.lateness import LambdaViews
from vigil.session import work_path
from vigil.sources.files import folder_stream
from vigil.streaming import detection, jobs

EVENTS = "event_id string, account_id string, amount double, lat double, lon double, ms bigint, produced_us bigint, arrival int, rate bigint"


def events(spark, n=120):
    r = random.Random(8)
    rows = [(f"{i:04}", r.choice("aab"), float(r.randrange(50)), float(r.randrange(-80, 80)), float(r.randrange(-170, 170)), i * 200 + r.randrange(100), i, i, 3) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def run(spark, df, name, parts=3):
    """The outcome of a stream over files that hold df in order, one file a micro-batch."""
    jobs.prepare(spark)
    source, out = work_path(spark, "in"), work_path(spark, "out")
    rows = df.count()
    for i in range(parts):
        df.filter((F.col("arrival") >= rows * i // parts) & (F.col("arrival") < rows * (i + 1) // parts)).coalesce(1).write.mode("append").parquet(source)
    stream = folder_stream(spark, source, EVENTS, files_per_trigger=1)
    query = name(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.read.parquet(out)


def test_judging_a_stream_equals_the_batch(spark):
    t = Thresholds(velocity_window_ms=2000, velocity_max=3)
    df = events(spark)
    got = {r["event_id"]: r for r in run(spark, df, lambda s: detection.judge_stream(s, t)).collect()}
    want = detect.judge(df, t).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["event_id"]]
        assert (g["velocity_prior"], g["n"], g["prev"]) == (r["velocity_prior"], r["n"], r["prev"])
        assert abs(g["mean"] - r["mean"]) < 1e-9 and abs(g["m2"] - r["m2"]) < 1e-6


def test_token_stream_equals_the_batch(spark):
    df = events(spark)
    got = {(r["event_id"], r["allowed"], r["wait_ms"]) for r in run(spark, df, lambda s: detection.token_stream(s, 60_000)).collect()}
    assert got == {(r["event_id"], r["allowed"], r["wait_ms"]) for r in folds.token_bucket(df, 60_000).collect()}


def test_dedup_stream_equals_the_batch(spark):
    df = events(spark).withColumn("event_id", (F.col("arrival") % 40).cast("string"))
    got = {(r["arrival"], r["accepted"]) for r in run(spark, df, lambda s: detection.dedup_stream(s, 9000)).collect()}
    assert got == {(r["arrival"], r["accepted"]) for r in folds.dedup_ttl(df, 9000).collect()}


def files(spark, df, ordered=False):
    source = work_path(spark, "in")
    for i in range(3):
        df.filter((F.floor(F.col("arrival") / 40) if ordered else F.col("arrival") % 3) == i).coalesce(1).write.mode("append").parquet(source)
    return folder_stream(spark, source, EVENTS, files_per_trigger=1)


def test_insert_once_and_dead_letters(spark):
    df = events(spark).withColumn("event_id", F.when(F.col("arrival") % 10 == 9, None).otherwise((F.col("arrival") % 40).cast("string")))
    stream = files(spark, df).withColumn("ok", F.col("event_id").isNotNull())
    table, rejected = work_path(spark, "table"), work_path(spark, "rejected")
    assert jobs.route(stream, "ok", table, rejected, "event_id", "arrival", work_path(spark, "cp")).awaitTermination(120)
    ids = [r["event_id"] for r in spark.read.parquet(table).collect()]
    assert len(ids) == len(set(ids)) == 36 and spark.read.parquet(rejected).count() == 12


def test_admitting_a_stream(spark):
    df = events(spark)
    stream = files(spark, df).select(F.lit("n").alias("ns"), F.unhex(F.md5((F.col("arrival") % 50).cast("string"))).alias("id"), F.col("arrival").cast("bigint").alias("row"))
    path = work_path(spark, "ids")
    assert jobs.admit_stream(stream, IdIndex(spark, path, prefix_bits=4, max_runs=9), work_path(spark, "cp")).awaitTermination(120)
    assert kept_rows(spark.read.parquet(f"{path}/batch-*")).count() == 50


def test_views_over_a_stream(spark):
    stream = files(spark, events(spark), ordered=True).withColumn("at", F.timestamp_micros(F.col("ms") * 1_000_000 - F.when(F.col("arrival") % 7 == 3, 7_200_000_000).otherwise(0))).withColumn("seen", F.timestamp_micros(F.col("ms") * 1_000_000 + 5))
    views = LambdaViews(spark, work_path(spark, "views"))
    checkpoint = work_path(spark, "cp")
    assert jobs.hourly_views(stream, views, "s", "at", "seen", 2, checkpoint).awaitTermination(120)
    again = LambdaViews(spark, views.path)
    assert jobs.hourly_views(stream, again, "s", "at", "seen", 2, checkpoint).awaitTermination(120)  # nothing new
    assert again.numbers == [0, 1, 2] and again.log().count() == 120
    again.recompute()
    view = again.view().collect()
    assert sum(r["n"] + r["refused"] for r in view) == 120 and sum(r["corrections"] for r in view) == again.log().filter("lateness = 'corrects'").count() > 0


def test_judging_restarts_after_a_pause_and_follows_the_cap(spark):
    t = Thresholds(velocity_window_ms=2000, velocity_max=3, stats_ttl_ms=900, zscore_cap=10)
    df = events(spark)
    got = {r["event_id"]: r for r in run(spark, df, lambda s: detection.judge_stream(s, t)).collect()}
    want = detect.judge(df, t).collect()
    assert len(got) == len(want) and len({r["n"] for r in want}) < 120
    for r in want:
        g = got[r["event_id"]]
        assert (g["velocity_prior"], g["n"], g["prev"]) == (r["velocity_prior"], r["n"], r["prev"])
        assert abs(g["mean"] - r["mean"]) < 1e-9 and abs(g["m2"] - r["m2"]) < 1e-6


def test_windows_come_out_behind_the_watermark(spark):
    df = events(spark).withColumn("at", F.timestamp_millis(F.col("ms")))
    source, out = work_path(spark, "in"), work_path(spark, "out")
    late = events(spark, 1).withColumn("at", F.timestamp_millis(F.lit(100))).withColumn("event_id", F.lit("late"))
    more = df.filter("arrival = 119")  # records are late by the watermark of the batch before
    for part in (df, more, late.withColumn("arrival", F.lit(500)), df.limit(1).withColumn("at", F.timestamp_millis(F.lit(3_600_000)))):
        part.coalesce(1).write.mode("append").parquet(source)
    schema = f"{EVENTS}, at timestamp"
    counted = detection.counts_stream(folder_stream(spark, source, schema, files_per_trigger=1), "at", "5 seconds", ["account_id"], "10 seconds")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    query = counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    jobs.prepare(spark)
    got = {(r["account_id"], r["window_us"]): r["n"] for r in spark.read.parquet(out).collect()}
    want = {(r["account_id"], r["w"]): r["n"] for r in df.unionByName(more).groupBy("account_id", F.unix_micros(F.window("at", "5 seconds")["start"]).alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want  # the late event is in none, the window of the last one is still open


def test_from_records_to_outbox_and_dead_letters(spark):
    jobs.prepare(spark)
    source, outbox, letters, checkpoints = (work_path(spark, n) for n in ("in", "outbox", "letters", "cp"))
    body = '{"eventId":"%s","accountId":"a","amount":%s,"lat":%s,"lon":0,"timestamp":"2020-06-01T00:00:%02dZ","more":1}'
    values = [body % (i, 5, 80 if i % 2 else -80, i) for i in range(6)] + [body % (3, 5, 80, 3), "NOT_VALID_JSON", None, body % ("", 5, 0, 8), body % (9, -1, 0, 9)]
    rows = [(f"k{i}", v, 1000 * i) for i, v in enumerate(values)]
    made = spark.createDataFrame(rows, "key string, value string, ms bigint").select("key", F.encode("value", "UTF-8").alias("value"), F.timestamp_millis("ms").alias("timestamp"), F.array().cast("array<struct<key:string,value:binary>>").alias("headers"))
    made.coalesce(1).write.parquet(source)
    schema = "key string, value binary, timestamp timestamp, headers array<struct<key:string,value:binary>>"
    for _ in range(2):  # a second start finds nothing new
        for query in jobs.detection_jobs(folder_stream(spark, source, schema), Thresholds(velocity_max=4), outbox, letters, "payment.events", checkpoints):
            assert query.awaitTermination(180)
    alerts = {r["rule"]: r["n"] for r in spark.read.parquet(outbox).groupBy(F.get_json_object("payload", "$.ruleName").alias("rule")).agg(F.count("*").alias("n")).collect()}
    assert alerts == {"geo": 3, "velocity": 2}
    bad = {(r["key"], r["fault"], r["topic"]) for r in spark.read.parquet(letters).collect()}
    assert bad == {("k7", "undecodable", "payment.events.DLT"), ("k9", "invalid", "payment.events.DLT"), ("k10", "invalid", "payment.events.DLT")}
