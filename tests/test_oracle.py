import pytest

import __spark_entry__
from tests.oracle import compare, connection
from vellum.plans import catalog


@pytest.fixture(scope="module")
def con(sf_small):
    return connection(sf_small)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_small, con, name):
    assert compare(catalog.queries()[name](spark, sf_small), con, catalog.oracle_sql()[name]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
