"""Query registry and the views shared by all registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import prepare
from tidegauge.sources import views

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    items: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, items: str, sql: str | None = None):
    """Register ``fn(views)`` as a named query covering inventory ``items``."""

    def wrap(fn: Callable[[views.Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(views.Views(prepare(spark), sf_dir))

        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, items, run, sql)
        return fn

    return wrap


def r(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded output value; +0.0 folds negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def ms(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_millis(col)


# ---------------------------------------------------------------- oracle text shared by topics

TICKS = """ticks AS (
  SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, event_id AS agg_id, ts, value + 100 AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS qty,
         event_type IN ('error', 'view') AS buyer_maker, event_type, value, user_id
  FROM events)"""

BARS = TICKS + """,
bars AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, agg_id)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (ts, agg_id)) AS close, sum(qty) AS volume
  FROM ticks GROUP BY ALL),
nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM bars)"""

SETTLEMENTS = """settlements AS (
  SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, ts, (value - 100) / 1e5 AS rate
  FROM events WHERE event_type = 'signup')"""

SNAPSHOTS = """snapshots AS (
  SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, ts, CASE WHEN value > 1 THEN value END AS oi
  FROM events WHERE event_type = 'purchase')"""

TRADES = """trades AS (
  SELECT l_returnflag AS pair, o_orderdate AS open_date, l_shipdate AS close_date, l_extendedprice AS stake_amount,
         round(l_discount - l_tax, 4) AS profit_ratio,
         round(l_extendedprice * round(l_discount - l_tax, 4), 4) AS profit_abs, l_linestatus AS status,
         l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)"""

SCORES = """scores AS (
  SELECT l_linenumber AS cell, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 AS id,
         l_quantity AS raw, l_quantity / 60.0 + (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey) % 1000003 / 1e9 AS score,
         round(l_discount - l_tax, 4) AS fwd, CAST(l_discount > l_tax AS INTEGER) AS label
  FROM lineitem)"""

ACTIONS = BARS + """,
acts AS (
  SELECT symbol, ts, pos, close,
         CASE WHEN close > 160 THEN 1 WHEN close < 125 THEN 2 ELSE 0 END AS action
  FROM nb)"""
