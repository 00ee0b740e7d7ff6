import pytest
from actionflow.llm import queries

from tests.test_entry import BASE, connect, rows


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    got = queries.queries()[name](spark, BASE).toPandas()
    want = connect().execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names():
    assert sorted(int(n[2:].partition("_")[0]) for n in queries.queries()) == list(range(1, 11))
