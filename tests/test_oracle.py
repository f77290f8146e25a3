"""Every query against its SQL, on the small tables."""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as driver

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="module")
def sqls(spark):
    return driver.oracle_sql()


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, sqls, name):
    note = difference(spark, con, FOLDER, name, driver.queries()[name], sqls.get(name))
    assert note is None, note


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lang_a", "lang_b", "card_a", "card_b", "jaccard", "cosine"}
