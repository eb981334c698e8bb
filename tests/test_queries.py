"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import oracle
from factloom.queries import ORACLES, QUERIES

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 180


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    found = oracle.compare(spark, con, name, FOLDER)
    if found == "empty":  # nothing in the smallest tables: the next larger ones must show something
        found = oracle.compare(spark, oracle.duck(LARGER), name, LARGER)
    assert found == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
