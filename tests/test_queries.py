"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
# Training at full settings takes minutes; test_training.py covers these, and tests.compare runs them.
TRAINED = {"fit_stack", "tune_cv", "tune_forest", "walk_forward"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) - TRAINED))
def test_agrees_with_sql(spark, con, name):
    assert compare(driver.queries()[name](spark, FOLDER), con, driver.oracle_sql()[name]) == ""


@pytest.mark.parametrize(
    "name", sorted(set(driver.queries()) - set(driver.oracle_sql()) - TRAINED)
)
def test_has_rows(spark, name):
    assert driver.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
