"""A key that comes twice in a snapshot, as in tables of more than a million parts, is planned row by row."""

import pandas as pd
import pytest
from oracle import same

from shelfspark.plans import registry

KINDS = ["PROMO", "SMALL", "LARGE", "MEDIUM"]


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Added rows get their part's key and a million, so those of the first parts are the keys of the last."""
    at = tmp_path_factory.mktemp("parts")
    keys = [*range(4000), *range(1000000, 1004000)]
    pd.DataFrame({"p_partkey": keys, "p_name": "red ring", "p_brand": "Brand#1", "p_type": [KINDS[k // 7 % 4] for k in keys], "p_size": [k % 50 for k in keys], "p_retailprice": [900.0 + k % 10 for k in keys]}).to_parquet(at / "part.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["plan_modes", "quality_report", "retain_quarantined", "verify_plan_state", "apply_plan", "guard_deletions", "guard_quarantine"])
def test_keys_twice_match_sql(spark, parts, name):
    found = registry.queries()[name](spark, parts)
    same(found, registry.oracle_sql()[name], parts)
    assert found.count() > 0
