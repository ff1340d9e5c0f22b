import pytest
from oracle import same

from verso.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    same(QUERIES[name], ORACLES[name], spark)
