import pytest

from quizweave.llm.queries import QUERIES, SQL

from ..compare import SF, assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() == 200
