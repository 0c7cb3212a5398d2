import pytest

from rankfile.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01") > 0
