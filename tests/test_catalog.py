"""Every registered query against its SQL text, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from benchset import catalog
from benchset.check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(entry_point.queries()) and set(catalog.ORACLE) <= set(entry_point.oracle_sql())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).columns == ["parent_id", "filial_operating_revenue_max"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    good, text = compare(spark, con, SF_DIR, name, catalog.QUERIES[name], catalog.ORACLE[name])
    assert good, text
