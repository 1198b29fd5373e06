"""Physical plans: pushdown, pruning, no cartesian product."""

import tempfile

from pyspark.sql import functions as F

from tidegauge.catalog.base import REGISTRY
from tidegauge.catalog import load
from tidegauge.operators import joins
from tidegauge.plans.series import Series
from tidegauge.sources import files
from tidegauge.sources.views import Views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_symbol_and_time_reach_the_scan(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/bars"
    Views(spark, SF).bars.write.partitionBy("symbol").parquet(path)
    text = plan(files.candles(spark, path, "S1", end="2024-01-10").select("ts", "close"))
    assert "PartitionFilters: [isnotnull(symbol" in text
    assert "LessThanOrEqual(ts" in text
    assert "volume" not in text.split("ReadSchema")[1]


def test_bars_scan_only_needed_columns(spark):
    text = plan(Views(spark, SF).bars.select("symbol", "ts", "close"))
    schema = text.split("ReadSchema")[1]
    assert "event_type" not in schema and "props" not in schema  # event_id orders prints of one instant


def test_bars_use_hash_aggregation(spark):
    text = plan(Views(spark, SF).bars)
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_joins_have_no_cartesian_product(spark):
    v = Views(spark, SF)
    s = Series(("symbol",), "ts", (), 86_400)
    out = [
        joins.asof(v.bars.select("symbol", "ts"), v.settlements, s, ["rate"]),
        joins.nearest_gap(v.bars.select("symbol", "ts"), v.settlements, s),
        joins.interval_sum(v.bars.select("symbol", "ts", F.col("ts").alias("e")), v.settlements, s, "rate", 3600, ["symbol", "e"], "x"),
    ]
    for df in out:
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_registry_is_complete(spark):
    assert load() is REGISTRY and len(REGISTRY) > 150
