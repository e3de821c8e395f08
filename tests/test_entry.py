import pytest

import __spark_entry__ as contract
from tests.oracle_check import compare, oracle_connection
from workload import oracle as shop_sql
from workload import spark_queries

SF_DIR = "/root/testdata/sf0.001"
# The training-data queries have their own tests. Not SQL: model fits.
ROWS_ONLY = {"als_predictions", "als_cv_metrics", "cf_recommendations", "train_recommendations"}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


def test_every_query_has_sql_unless_it_fits_a_model():
    assert set(spark_queries.QUERIES) - set(shop_sql.oracle_sql()) == ROWS_ONLY
    assert set(spark_queries.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(set(spark_queries.QUERIES) - ROWS_ONLY))
def test_query_equals_sql(spark, oracle, name):
    assert compare(spark, oracle, name, SF_DIR) is None
