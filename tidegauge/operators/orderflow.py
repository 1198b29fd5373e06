"""Order-flow decay: does signed flow predict the return after it?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import joins, scoring, windows as w
from tidegauge.operators.bars import bucket
from tidegauge.plans.series import Series


def flow_bars(ticks: DataFrame, step: int) -> DataFrame:
    sign = F.when(F.col("buyer_maker"), -1.0).otherwise(1.0)
    return ticks.groupBy("symbol", bucket("ts", step).alias("ts")).agg(
        F.sum(sign * F.col("qty")).alias("signed"),
        F.sum("qty").alias("vol"),
        F.max_by("price", F.struct("ts", "agg_id")).alias("px"),
    )


def decay_table(ticks: DataFrame, s: Series, step: int, window: int, horizon: int, q: int) -> DataFrame:
    """Mean forward return in basis points per quantile of trailing imbalance."""
    flow = flow_bars(ticks, step)
    # sums over a trailing time range; the window ends with the current bar
    rolled = w.trailing_seconds(flow, s, window - step + 1, {"sv": "signed", "vv": "vol"})
    rolled = rolled.select("symbol", "ts", F.col("px").alias("px0"), w.ratio(F.col("sv"), F.col("vv")).alias("imb"))
    later = rolled.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(horizon)))
    hit = joins.asof(later, flow.select("symbol", "ts", "px"), s, ["px"], "forward")
    ret = hit.filter(F.col("px").isNotNull() & F.col("imb").isNotNull()).select(
        F.lit(0).alias("all"), "imb", (F.col("px") / F.col("px0") - 1).alias("ret")
    )
    b = scoring.quantile_buckets(ret, ["all"], "imb", q)
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") * 1e4).alias("mean_bp"))
