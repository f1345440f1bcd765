"""Every registered query against its SQL on the smallest data."""

import pytest

from checks.compare import compare, connect
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, note
    assert ", types" not in note, note


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns == driver.queries()["search_stack"](spark, SF_DIR).columns
    assert set(driver.oracle_sql()) <= set(driver.queries())
