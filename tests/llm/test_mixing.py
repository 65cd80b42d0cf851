import random
from collections import Counter

from pyspark.sql import functions as F

from vigil.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, copies int, threshold int"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, sizes):
    rows, n = [], 0
    for source, lengths in sizes.items():
        for length in lengths:
            rows.append((n, "x" * length if length is not None else None, source, 9, 9))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    r = random.Random(4)
    df = docs(spark, {"big": [r.randrange(1, 400) for _ in range(3000)], "mid": [r.randrange(1, 200) for _ in range(500)], "small": [r.randrange(1, 50) for _ in range(40)], "other": [5] * 50, None: [7, 8]})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)], TARGETS)
    rows = M.mix(df, targets, calibrated=True).collect()
    used = Counter(x["doc_id"] for x in rows)
    source = {x["doc_id"]: x["source"] for x in rows}
    most = {"big": 1, "mid": 2, "small": 4}
    assert all(n <= most[source[i]] for i, n in used.items())
    assert len({(x["doc_id"], x["copy_no"]) for x in rows}) == len(rows) and rows[0]["copies"] == 9
    tokens = Counter()
    for x in rows:
        tokens[x["source"]] += x["n_tokens"]
    total = sum(tokens.values())
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(tokens[s] / total - share / 0.95) < 0.01
    assert min(used[i] for i in used if source[i] == "small") == 4  # the source that binds is used up
    report = {x["source"]: x for x in M.share_report(df, targets, calibrated=True).collect()}
    assert report["absent"]["used"] == 0 and report["other"]["used"] == 0 and report["other"]["tokens"] == 250 and None not in report
    assert report["big"]["used"] == tokens["big"]


def test_independent_draws_have_the_rate_as_their_mean(spark):
    r = random.Random(5)
    df = docs(spark, {"big": [r.randrange(1, 40) for _ in range(6000)], "small": [r.randrange(1, 40) for _ in range(1000)]})
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3)], TARGETS)
    plan = {x["source"]: x for x in M.mix_plan(df, targets).collect()}
    uses = Counter(x["doc_id"] for x in M.mix(df, targets).collect())
    for source, ids in (("big", range(6000)), ("small", range(6000, 7000))):
        rate, n = plan[source]["rate"], [uses[i] for i in ids]
        assert set(n) <= {int(rate), int(rate) + 1} and plan[source]["copies"] == int(rate) and plan[source]["threshold"] == rate - int(rate)
        assert abs(sum(n) / len(n) - rate) < 4 * (0.25 / len(n)) ** 0.5 + 1e-9
    report = {x["source"]: x["actual_share"] for x in M.share_report(df, targets).collect()}
    assert abs(report["big"] - 0.4) < 0.03 and abs(sum(report.values()) - 1) < 1e-6
    assert all(x["within_repeats"] and x["near_target"] for x in M.properties(df, targets).collect())


def test_same_on_every_partitioning_and_other_with_another_seed(spark):
    df = docs(spark, {"a": list(range(1, 200)), "b": [3] * 20})
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS)
    picks = lambda d, seed=M.SEED: sorted((x["doc_id"], x["copy_no"]) for x in M.mix(d, targets, seed).collect())
    assert picks(df.repartition(1)) == picks(df.repartition(9)) != picks(df, "other")


def test_odd_targets_and_empty(spark):
    df = docs(spark, {"a": [None, 0, 4], "b": [5]})
    odd = spark.createDataFrame([("a", 0.0, 1), ("b", 1.0, 0), (None, 0.5, 1), ("c", None, None)], TARGETS)
    assert M.mix(df, odd).count() == 0 and M.share_report(df, odd).filter(F.col("used") > 0).count() == 0
    one = spark.createDataFrame([("a", 1.0, 3)], TARGETS)
    assert [(x["doc_id"], x["copy_no"]) for x in M.mix(df, one).orderBy("copy_no").collect()] == [(2, 1), (2, 2), (2, 3)]
    assert M.mix(docs(spark, {}), one).count() == 0 and M.mix(df, spark.createDataFrame([], TARGETS)).count() == 0
