"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest
from compare import SMALL, compare, connect

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        assert compare(spark, con, QUERIES[name], ORACLE[name], SMALL) is None
    else:
        QUERIES[name](spark, SMALL).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
