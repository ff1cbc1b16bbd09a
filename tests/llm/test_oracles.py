import pytest

from paperloom.llm import registry
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.001") == []
