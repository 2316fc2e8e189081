"""Every registered query of the subpackage runs; those with SQL give its rows."""

import pytest
from oracle import actual, expected

from gleanery.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    got = actual(registry.queries()[name](spark, sf_dir))
    assert got[1]
    if name in SQL:
        assert got == expected(SQL[name], sf_dir)


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in registry.queries()]
    assert sorted(numbers) == list(range(1, 11))
