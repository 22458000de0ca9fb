import pytest

from kinfold.llm import oracles, queries

from ..test_queries import check, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, queries.queries()[name], oracles.oracle_sql()[name])


def test_names():
    assert set(oracles.oracle_sql()) <= set(queries.queries())
