"""Market views over the star-schema tables.

Each view is a lazy projection or aggregation; nothing is cached or collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import bars as bars_ops
from tidegauge.plans.series import Series

TICK_SERIES = Series(("symbol",), "ts", ("agg_id",), span=3600)
BAR_SERIES = Series(("symbol",), "ts", (), span=30 * 86_400)


class Views:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        # the file stores zone-less instants; they are UTC by convention
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def ticks(self) -> DataFrame:
        e = self.events
        return e.select(
            F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
            F.col("event_id").alias("agg_id"),
            "ts",
            (F.col("value") + 100).alias("price"),
            (F.get_json_object("props", "$.k").cast("double") + 1).alias("qty"),
            F.col("event_type").isin("error", "view").alias("buyer_maker"),
            "event_type",
            "value",
            "user_id",
        )

    @cached_property
    def bars(self) -> DataFrame:
        return bars_ops.ohlcv(self.ticks, 3600)

    @cached_property
    def settlements(self) -> DataFrame:
        e = self.events.filter(F.col("event_type") == "signup")
        return e.select(
            F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
            "ts",
            ((F.col("value") - 100) / 1e5).alias("rate"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        e = self.events.filter(F.col("event_type") == "purchase")
        return e.select(
            F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
            "ts",
            F.when(F.col("value") > 1, F.col("value")).alias("oi"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        return self._trades(self.table("lineitem"))

    def trades_on(self, days: DataFrame) -> DataFrame:
        """Trades of some pairs on some close days, with file and row of their line items: the order of the table.

        Line items of other days never meet the orders.
        """
        li = self.table("lineitem").withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
        of = (li["l_returnflag"] == days["pair"]) & (F.to_date(li["l_shipdate"].cast("timestamp")) == days["day"])
        return self._trades(li.join(days, of, "left_semi"), "file", "row")

    def _trades(self, li: DataFrame, *place: str) -> DataFrame:
        # ratio and result are worked out before the join, so that it moves no column that only they need
        ratio = F.round(F.col("l_discount") - F.col("l_tax"), 4)
        li = li.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate",
            ratio.alias("profit_ratio"), F.round(F.col("l_extendedprice") * ratio, 4).alias("profit_abs"), *place,
        )
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        return (
            li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .filter(F.col("l_shipdate") >= F.col("o_orderdate"))
            .select(
                F.col("l_returnflag").alias("pair"),
                F.col("o_orderdate").cast("timestamp").alias("open_date"),
                F.col("l_shipdate").cast("timestamp").alias("close_date"),
                F.col("l_extendedprice").alias("stake_amount"),
                "profit_ratio",
                "profit_abs",
                F.col("l_linestatus").alias("status"),
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line"),
                F.col("l_partkey").alias("part_id"),
                F.col("l_suppkey").alias("supp_id"),
                *place,
            )
        )

    @cached_property
    def scores(self) -> DataFrame:
        li = self.table("lineitem")
        nudge = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey")) % 1000003 / 1e9
        return li.select(
            F.col("l_linenumber").alias("cell"),
            (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("id"),
            F.col("l_quantity").alias("raw"),
            (F.col("l_quantity") / 60.0 + nudge).alias("score"),
            F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("fwd"),
            (F.col("l_discount") > F.col("l_tax")).cast("int").alias("label"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Per-bar action codes: 1 buy, 2 sell, 0 hold, from close bands."""
        code = F.when(F.col("close") > 160, 1).when(F.col("close") < 125, 2).otherwise(0)
        return self.bars.select("symbol", "ts", "close", code.alias("action"))
