import pytest

from tests.edge import empty_tables, odd_tables
from vigil.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing_gives_nothing(spark, folder, tmp_path, name):
    assert QUERIES[name](spark, empty_tables(spark, folder, str(tmp_path))).collect() == []


@pytest.fixture(scope="module")
def odd(spark, folder, tmp_path_factory):
    return odd_tables(spark, folder, str(tmp_path_factory.mktemp("odd")))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeated_rows_and_clashing_columns(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name in ("p6_properties", "p7_properties"):
        assert all(v for r in rows for k, v in r.asDict().items() if name == "p7_properties" or k == "within_capacity")
    if name == "p6_packs":  # rows that repeat are packed as often as they come, null texts come out without a container
        assert sum(r["doc_id"] is None for r in rows) == 2 * len({r["pack_name"] for r in rows})
