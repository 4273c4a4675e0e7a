import pytest

from scrubline.llm.queries import oracle_sql, queries
from tests.oracle import DATA, connect, rows


@pytest.mark.parametrize("name", oracle_sql())
def test_sql(spark, name):
    assert rows(queries()[name](spark, DATA).toPandas()) == rows(connect().execute(oracle_sql()[name]).df())


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
