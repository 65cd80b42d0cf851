import glob
import os

import duckdb
import pytest

from tests.test_entry import rows
from vigil.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name in SQL:
        con = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        assert rows(got) == rows(con.execute(SQL[name]).df())
