import pytest

from calamus.plans import catalog, oracle
from tests.compare import assert_same

QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(name, spark, sf, duck):
    assert_same(QUERIES[name](spark, sf), duck, SQL[name])
