"""Every query with SQL gives the SQL's rows; every other gives rows."""

import oracle
import pytest

from fieldsense.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert not QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
