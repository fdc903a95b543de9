"""The operators' queries that have SQL, against it."""

import pytest

from plantables.llm import queries
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name]) is None
