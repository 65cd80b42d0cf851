import random

from pyspark.sql import functions as F

from vigil.operators import features as X

EVENTS = "id string, seq bigint, entity string, type string, at_us bigint, batch bigint"


def brute(rows):
    last = {}
    for r in sorted(rows, key=lambda r: r[1]):
        last[r[0]] = r
    out = {}
    for _, _, e, t, at, _ in last.values():
        n, latest = out.get((e, t), (0, None))
        out[e, t] = n + 1, at if latest is None else latest if at is None else max(latest, at)
    return out


def state(spark, rows):
    of = X.versions(spark.createDataFrame(rows, EVENTS), F.col("batch") > 0)
    return X.apply_deltas(X.state_of("before", of), X.signed_deltas(of), of.select("now.*"))


def as_dict(df):
    rows = df.collect()
    assert len({(r["entity"], r["type"]) for r in rows}) == len(rows)
    return {(r["entity"], r["type"]): (r["n"], r["latest_us"]) for r in rows}


def test_deltas_equal_counting_anew(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(f"i{r.randrange(150)}", i, r.choice(["hot", "hot", "a", "b", None]), r.choice(["x", "y", "X", None]), r.choice([None, *range(20)]), int(i > 250)) for i in range(400)]
        assert as_dict(state(spark, rows)) == brute(rows)


def test_latest_is_recomputed_where_it_was_retracted(spark):
    rows = [("1", 1, "a", "x", 10, 0), ("2", 2, "a", "x", 30, 0), ("3", 3, "a", "x", 20, 0), ("4", 4, "b", "x", 5, 0)]
    assert as_dict(state(spark, [*rows, ("2", 5, "a", "x", 1, 1)])) == {("a", "x"): (3, 20), ("b", "x"): (1, 5)}
    assert as_dict(state(spark, [*rows, ("4", 5, "a", "x", 5, 1)])) == {("a", "x"): (4, 30)}  # a pair without events is gone
    assert as_dict(state(spark, [*rows, ("2", 5, "a", "x", 30, 1)])) == {("a", "x"): (3, 30), ("b", "x"): (1, 5)}


def test_a_store_kept_batch_by_batch_equals_counting_anew(spark, tmp_path):
    import shutil

    from vigil.session import work_path

    for seed, max_runs in ((5, 2), (6, 9)):
        r, path = random.Random(seed), work_path(spark, "store")
        rows = [(f"i{r.randrange(120)}", i, r.choice(["hot", "hot", "a", "b", None]), r.choice(["x", "y", None]), r.choice([None, *range(20)]), i // 100) for i in range(500)]
        for number in range(5):
            of = [x for x in rows if x[5] == number]
            spark.createDataFrame(of, EVENTS).write.parquet(f"{tmp_path}/{seed}-{number}")
            store = X.FeatureStore(spark, path, max_runs)
            for _ in range(2):  # a batch that comes again is not added again
                store.add(spark.read.parquet(f"{tmp_path}/{seed}-{number}").drop("batch"), number)
            shutil.rmtree(f"{tmp_path}/{seed}-{number}")  # later batches do not read it
            assert as_dict(X.FeatureStore(spark, path).state()) == brute([x for x in rows if x[5] <= number])


def test_an_older_version_that_comes_later_changes_nothing(spark):
    from vigil.session import work_path

    store = X.FeatureStore(spark, work_path(spark, "store"))
    store.add(spark.createDataFrame([("1", 5, "a", "x", 10, 0), ("2", 6, "a", "x", 3, 0)], EVENTS).drop("batch"), 0)
    store.add(spark.createDataFrame([("1", 4, "b", "y", 99, 1)], EVENTS).drop("batch"), 1)
    assert as_dict(store.state()) == {("a", "x"): (2, 10)}
    store.add(spark.createDataFrame([("1", 7, "b", "y", 1, 2)], EVENTS).drop("batch"), 2)
    assert as_dict(store.state()) == {("a", "x"): (1, 3), ("b", "y"): (1, 1)}


def test_table_with_names_that_differ_in_signs_or_case(spark):
    names = ["geo", "GEO", "geo.", "geo ", "Geo/1h", "geo_1h"]
    rows = [(str(i), i, "a", n, i, 0) for i, n in enumerate(names)] + [("n", 99, "a", None, 99, 0), ("m", 98, None, "geo", 98, 1)]
    st = state(spark, rows)
    columns = [X.feature_column("n", n) for n in names]
    assert len({c.lower() for c in columns}) == len(names)
    wide = X.feature_table(st, X.type_names(st, spark.createDataFrame([("never",)], "rule_name string")))
    got = {r["entity"]: r.asDict() for r in wide.collect()}
    assert got["a"]["n_total"] == 7 and got["a"]["latest_total_us"] == 99 and all(got["a"][c] == 1 for c in columns)
    assert got["a"][X.feature_column("n", "never")] == 0 and got["a"][X.feature_column("latest_us", "never")] is None
    assert got[None]["n_total"] == 1 and got[None][X.feature_column("latest_us", "geo")] == 98


def test_empty(spark):
    st = state(spark, [])
    assert st.collect() == [] and X.feature_table(st, X.type_names(st)).collect() == []


def test_wide_equals_long_on_test_data(spark, folder):
    from vigil.plans.found import QUERIES

    table = QUERIES["p5_features"](spark, folder)
    table = table.select(*[F.unix_micros(c).alias(c) if kind == "timestamp" else c for c, kind in table.dtypes])
    wide = {r["account_id"]: r.asDict() for r in table.collect()}
    total = 0
    for r in QUERIES["p5_features_long"](spark, folder).collect():
        row = wide[r["account_id"]]
        assert row[X.feature_column("n", r["rule_name"])] == r["n"] and row[X.feature_column("latest", r["rule_name"])] == r["latest_us"]
        total += r["n"]
    assert total == sum(r["n_total"] for r in wide.values())
