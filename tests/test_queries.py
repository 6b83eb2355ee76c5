"""Every registered query against its SQL, on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check import connect, schema_of, spark_rows, sql_rows
from tallyframe.plans import ORACLES
from tallyframe.plans import QUERIES as NAMES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not here")
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(NAMES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    got = spark_rows(df)
    if name not in ORACLES:
        assert got
        return
    schema, want = sql_rows(db, ORACLES[name])
    assert schema_of(df) == schema
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
