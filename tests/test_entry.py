import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

#: Some queries of the subpackage are tested with it.
CORE = sorted(n for n in entry.queries() if not n.startswith(("p6_", "p7_", "p8_")))


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(str, map(clean, r))) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    import glob
    import os

    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() >= 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, folder, duck, name):
    got = entry.queries()[name](spark, folder).toPandas()
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    if sql := entry.oracle_sql().get(name):
        want = duck.execute(sql).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(got) == rows(want)
