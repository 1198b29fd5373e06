"""Mechanical market regime: trend by averages and ADX, volatility by ATR rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import windows as w
from tidegauge.operators.indicators import with_adx
from tidegauge.plans.series import Series, block_size, framed, memory


def market_regime(
    df: DataFrame, s: Series, fast: int = 50, slow: int = 200, period: int = 14, trend: float = 20.0, lookback: int = 30, high: float = 0.70
) -> DataFrame:
    """bull/bear/sideways with ``_high_vol`` suffix; null while any input warms up."""
    decay = 1 - 1 / period
    back = max(slow, 2 * memory(decay) + lookback)

    def build(d, b):
        d = with_adx(d, b, period, "ewm")
        return d.withColumns(
            {
                "__f": w.sma(b, F.col("close"), fast),
                "__s": w.sma(b, F.col("close"), slow),
                "vol_rank": w.average_rank_share(b, F.col("atr"), lookback),
            }
        )

    out = framed(df, s, build, back=back, size=block_size([decay], back))
    f, sl, a, v = F.col("__f"), F.col("__s"), F.col("adx"), F.col("vol_rank")
    known = f.isNotNull() & sl.isNotNull() & a.isNotNull() & v.isNotNull()
    way = F.when((f > sl) & (a > trend), "bull").when((f < sl) & (a > trend), "bear").otherwise("sideways")
    suffix = F.when(v > high, "_high_vol").otherwise("")
    return out.withColumn("regime", F.when(known, F.concat(way, suffix))).drop("__f", "__s")
