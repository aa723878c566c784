import pytest

import __spark_entry__ as contract
from compare import compare, connect
from rondas.plans.catalogue import QUERIES

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(contract.queries()[name](spark, sf_dir), con, ORACLES[name]) == ""


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:4] == ["codigo", "asiste", "programada_id", "orden"]
    assert df.limit(1).count() == 1
