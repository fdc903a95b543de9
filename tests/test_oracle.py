"""Every registered query of the reference's operators against its oracle, on the smallest tables."""

import pytest

from plantables import plans  # noqa: F401
from plantables.plans import registry
from tests.compare import compare

SF = "/root/testdata/sf0.001"
#: Queries whose right result has no rows there.
EMPTY = {"q11_not_in_with_null", "c7_term_load", "g2_closure_cyclic"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    found = compare(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert found is None or found == "no rows" and name in EMPTY
