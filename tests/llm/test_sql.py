"""The queries that SQL can express."""

import pytest

from skyweave.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], SQL[name])


def test_all_are_registered():
    assert [f"op{n}" for n in range(1, 14)] == [x.split("_")[0] for x in queries.queries()]
