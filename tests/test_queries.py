"""Every registered query against its SQL; those without SQL must run and be whole."""

from __future__ import annotations

import pytest
from oracle import SF, database, same

from seqloom import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    same(QUERIES[name](spark, SF), db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns[-1] == "n" and out.count() == 1


def test_names_of_the_entry():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
