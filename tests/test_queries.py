import pytest
from oracle import same

from verso.plans.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    same(QUERIES[name], ORACLES[name], spark)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0
