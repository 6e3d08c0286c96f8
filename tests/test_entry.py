"""The driver contract."""

import os

import pytest

import __spark_entry__ as contract


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["id", "kind", "distance"] and found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan
