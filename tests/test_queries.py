"""Every catalog query against SQL written apart from it."""

import pytest
from oracle import same

from shelfspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
