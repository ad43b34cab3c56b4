import pytest

from rillflow.llm import registry
from tests.test_oracles import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.01")
