"""Resampling queries at the published replicate counts, against their SQL text with these counts, on few rows."""

import os

import pyarrow.parquet as pq
import pytest

from tests.check import connect, diff, oracle
from tidegauge.catalog import load

SF = "/root/testdata/sf0.001"
BLOCK = (("ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING", "ROWS BETWEEN CURRENT ROW AND 499 FOLLOWING"), ("n / 24.0", "n / 500.0"), ("n - 24 + 1", "n - 500 + 1"), ("c = 24", "c = 500"))
#: Query, replicates in its SQL, published replicates, other published numbers.
CASES = (
    ("bootstrap_mean_difference", 100, 2000, ()),
    ("paired_bootstrap_premium_difference", 40, 10000, ()),
    ("moving_block_theta", 200, 10000, BLOCK),
    ("calendar_week_block_theta", 200, 10000, ()),
    ("cluster_bootstrap_mean", 500, 10000, ()),
    ("resampled_sharpe_interval", 100, 10000, ()),
    ("matched_control_monte_carlo", 200, 2000, ()),
)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    d = tmp_path_factory.mktemp("few")
    for name in os.listdir(SF):
        if name == "lineitem.parquet":
            pq.write_table(pq.read_table(f"{SF}/{name}").slice(0, 200), d / name)
        else:
            os.symlink(f"{SF}/{name}", d / name)
    return str(d)


@pytest.mark.parametrize("name, small, published, other", CASES)
def test_published_counts(spark, few, name, small, published, other):
    catalog = load()
    own = catalog[f"{name}_published"].sql
    sql = own or catalog[name].sql
    for old, new in ((f"range(0, {small})", f"range(0, {published})"), *other) if not own else ():
        assert sql.count(old) == 1
        sql = sql.replace(old, new)
    at = SF.replace("0.001", "0.01") if other else few  # blocks of 500 need longer series
    got = catalog[f"{name}_published"].run(spark, at).toPandas()
    assert len(got) > 0 and diff(got, oracle(connect(at), sql)) is None
