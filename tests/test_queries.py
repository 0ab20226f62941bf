"""Every query with SQL gives the same rows as DuckDB; the others run and give rows."""

import pytest

from quire.plans import block_queries, experiment_queries, paragraph_queries, style_queries  # noqa: F401
from quire.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
