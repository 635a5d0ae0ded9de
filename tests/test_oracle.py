import pytest

from sparkrank.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
