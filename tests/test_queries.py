import pytest

import __spark_entry__ as entry
from compare import compare, connect
from vacanta.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
# Where nothing stands out on the smallest tables, a query must return rows on these.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, sf_dir, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    if problem == "no rows on either side":
        problem = compare(spark, connect(LARGER), name, QUERIES[name], ORACLES.get(name), LARGER)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_the_entry_has_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
