import pytest

from paperloom.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLES[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
