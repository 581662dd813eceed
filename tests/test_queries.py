import pytest
from oracle import compare, connect

from tessera.queries import ORACLE_SQL, QUERIES

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE_SQL[name], BASE) >= 0
