import random
import uuid

from pyspark.sql import functions as F

from tests.brute import canonical
from vigil.functions.ids import canonical_uuid, uuid5, uuid_bytes
from vigil.model import ALERT_NAMESPACE
from vigil.operators import idindex as I
from vigil.session import work_path


def test_every_way_to_write_a_uuid(spark):
    u = "1c8d6a9c-c5f9-5351-8dec-b5af762e1d82"
    same = [u, u.upper(), u.replace("-", ""), f"urn:uuid:{u}", f"{{{u}}}", f"({u})", f"\t{u} ", f" {u}\n", "1C8D6A9Cc5f953518decb5AF762E1D82", f"URN:UUID:{u.upper()}"]
    other = [None, "", " ", "n/a", "unknown", u[:-1], u + "0", u.replace("1c", "1g"), f"x{u}", "{}", "a" * 100_000]
    rows = spark.createDataFrame([(x,) for x in same + other], "x string").select(canonical_uuid(F.col("x"))).collect()
    assert [r[0] for r in rows] == [u] * len(same) + [None] * len(other)


def test_line_breaks_at_the_end_of_a_uuid(spark):
    u = "1c8d6a9c-c5f9-5351-8dec-b5af762e1d82"
    rows = [(u + end,) for end in ("\n", "\r\n", "\r", "\n\n", "\u0085", "\u2028", "\u2029")] + [(u.replace("-", "") + "\n",)]
    ids = spark.createDataFrame(rows, "x string").select(canonical_uuid(F.col("x")).alias("c")).select("c", uuid_bytes(F.col("c")).alias("b")).collect()
    assert all((r["c"] is None) == (r["b"] is None) for r in ids)  # else a row would be neither unnamed nor admitted
    assert [r["c"] for r in ids[:4] + ids[-1:]] == [u] * 5


def test_uuid5_equals_the_standard_library(spark):
    names = ["0:velocity", "1:velocity", "ev-ü:geo", ""]
    rows = spark.createDataFrame([(x,) for x in names], "x string").select(uuid5(ALERT_NAMESPACE, F.col("x"))).collect()
    assert [r[0] for r in rows] == [str(uuid.uuid5(uuid.UUID(ALERT_NAMESPACE), x)) for x in names]
    assert rows[0][0] == "cbcc1248-39de-58c4-8ce9-b356bd312041"


def messages(spark, rows):
    return spark.createDataFrame(rows, "ns string, u string, row bigint, batch bigint").select("ns", uuid_bytes(canonical_uuid(F.col("u"))).alias("id"), "row", "batch")


def random_rows(n, ids, seed=5):
    r = random.Random(seed)
    pool = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(ids)] + ["00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffff000000"]
    return [(r.choice("ab"), pool[0] if r.random() < 0.3 else r.choice(pool), i, i * 10 // n) for i in range(n)]


def expected(rows):
    first, count = {}, {}
    for ns, u, row, _ in rows:
        key = ns, canonical(u)
        count[key] = count.get(key, 0) + 1
        first.setdefault(key, row)
    return {(k[0], v) for k, v in first.items()}, {k for k, n in count.items() if n > 1}


def check(out, rows):
    kept, repeated = expected(rows)
    got = [tuple(r) for r in I.kept_rows(out).collect()]
    assert len(got) == len(set(got)) and set(got) == kept
    assert {(r["ns"], str(uuid.UUID(bytes=bytes(r["id"])))) for r in I.repeated_ids(out).collect()} == repeated


def test_one_copy_of_each_in_any_number_of_waves(spark):
    rows = random_rows(3000, 900)
    for waves in (1, 3, 7):
        index = I.IdIndex(spark, work_path(spark, "ids"), prefix_bits=5, max_runs=3)
        check(I.admit_all(index, messages(spark, rows), waves), rows)
        assert len(index.live()) <= 4


def test_batches_may_be_repeated_and_the_index_reopened_with_more_prefixes(spark):
    rows = random_rows(800, 300, 9)
    path = work_path(spark, "ids")
    waves = I.in_waves(messages(spark, rows), 3)
    first = I.IdIndex(spark, path, prefix_bits=4)
    first.admit(waves[0].select("ns", "id", "row"), 0)
    first.admit(waves[0].select("ns", "id", "row"), 0)
    second = I.IdIndex(spark, path, prefix_bits=6)
    outs = [second.admit(w.select("ns", "id", "row"), i) for i, w in enumerate(waves)]
    check(outs[0].unionByName(outs[1]).unionByName(outs[2]), rows)
    second.merge()
    assert len(second.live()) == 1 and second.live()[0][3] == 6


def test_sorted_arrays_and_empty(spark):
    index = I.IdIndex(spark, work_path(spark, "ids"), prefix_bits=4)
    out = index.admit(messages(spark, random_rows(500, 200)).select("ns", "id", "row"), 0)
    for r in out.collect():
        each = [bytes(r["ids"][i : i + I.WIDTH]) for i in range(0, len(r["ids"]), I.WIDTH)]
        assert each == sorted(set(each)) and len(each) == len(r["rows"]) and len(r["ids"]) % I.WIDTH == 0
    empty = I.IdIndex(spark, work_path(spark, "ids"))
    assert I.admit_all(empty, messages(spark, []), 3).count() == 0
    assert I.prefix_bits_for(0) == 4 and I.prefix_bits_for(10**12) == 26


def test_a_second_batch_reads_itself_and_the_index_alone(spark, tmp_path):
    rows, path = random_rows(600, 200, 4), work_path(spark, "ids")
    halves = [rows[:300], rows[300:]]
    for i, half in enumerate(halves):
        messages(spark, half).write.parquet(f"{tmp_path}/{i}")
    outs = []
    for i in range(2):
        outs.append(I.IdIndex(spark, path, prefix_bits=4).admit(spark.read.parquet(f"{tmp_path}/{i}").select("ns", "id", "row"), i))
        import shutil

        shutil.rmtree(f"{tmp_path}/{i}")  # the first batch is gone when the second comes
    check(outs[0].unionByName(outs[1]), rows)


def test_deduplicated_tables_keep_rows_without_identifier(spark, folder):
    from vigil.plans.found import QUERIES
    from vigil.sources.tables import table

    rows = table(spark, folder, "alert_messages").select("row_id", "alert_id").collect()
    named = {canonical(r["alert_id"]) for r in rows} - {None}
    got = QUERIES["p4_alert_messages"](spark, folder).select("row_id", "alert_id").collect()
    assert len(got) == len(named) + sum(canonical(r["alert_id"]) is None for r in rows)
