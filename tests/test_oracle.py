"""Every registered query against its independent SQL."""

import pytest
from comparing import differences, duck
from builders import SF_SMALL

import __spark_entry__ as registered

QUERIES, ORACLE = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        assert differences(spark, con, QUERIES[name], ORACLE[name], SF_SMALL) == {}
    else:
        assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() > 0
