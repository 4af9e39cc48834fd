"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SMALL) == ""


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 250


@pytest.mark.parametrize("name", ["t06_t11_forest_predictions", "t08_l08_regression_forest", "t20_l09_feature_importance"])
def test_model_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
