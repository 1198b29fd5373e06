"""Every registered query against its SQL text, on the smallest tables."""

import os

import pytest

from tests.check import connect, diff, oracle
from tidegauge.catalog import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql is not None])
def test_matches_oracle(spark, con, name):
    got = CATALOG[name].run(spark, SF).toPandas()
    assert diff(got, oracle(con, CATALOG[name].sql)) is None


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql is None and "model" not in n])
def test_runs(spark, name):
    df = CATALOG[name].run(spark, SF)
    assert len(df.columns) > 0 and df.count() >= 0


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
