"""The recovery of texts cleans and counts each text once."""

import pytest

from quire.plans.catalog import QUERIES

from .conftest import SMALL


@pytest.mark.parametrize("name", ["f8_recover", "t3_recovery_examples"])
def test_patterns_are_run_once(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 20
