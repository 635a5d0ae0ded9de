import pytest

from sparkrank.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.SQL[name])


def test_operators_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
