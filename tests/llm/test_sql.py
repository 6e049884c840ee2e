import pytest
from helpers import compare

from strandwise.llm import registry

Q, O = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_query_equals_sql(spark, duck, sf, name):
    compare(spark, duck, sf, Q[name], O[name])
