"""Every registered query against its SQL, or for a row count where there is none."""

import pytest

import __spark_entry__ as driver
from compare import difference
from conftest import FOLDER

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    result = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert difference(result, database, SQL[name]) is None
    else:
        assert result.count() > 0


def test_sql_has_no_orphans():
    from oracles import all_oracles

    assert set(all_oracles()) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
