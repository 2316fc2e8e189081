"""Every registered core query runs; those with SQL give its rows."""

import pytest
from oracle import actual, expected

from gleanery.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    got = actual(df)
    if name in SQL:
        assert got == expected(SQL[name], sf_dir)
    else:
        assert got[0] == sorted(df.columns)


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).columns == ["qid", "id", "score", "rank"]


def test_entry_point_lists_them():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
