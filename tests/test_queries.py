"""Every registered query runs and, where SQL can say it, equals its SQL."""

import pytest

import __spark_entry__ as entry
from seawake.plans import registry

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, oracle, name):
    got = entry.queries()[name](spark, small).toArrow()
    assert got.num_rows
    if name in registry.ORACLE_SQL:
        want = oracle(registry.ORACLE_SQL[name])
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
