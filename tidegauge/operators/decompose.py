"""Split of a ledger's result into drift, timing and friction (descriptive)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.positions import FEE, SLIP, ledger
from tidegauge.plans.series import Series


def drift_timing_friction(tracked: DataFrame, s: Series, stake: float = 100.0) -> DataFrame:
    """Net = exposure * buy-and-hold + timing - friction, per key."""
    trades = ledger(tracked, s, stake)
    own = trades.groupBy(*s.keys).agg(
        (F.sum("gross") / stake).alias("gross"),
        (F.sum("net") / stake).alias("net"),
        (F.sum(F.col("fee") + F.col("slippage")) / stake).alias("friction"),
        F.count(F.lit(1)).alias("n_trades"),
    )
    market = tracked.groupBy(*s.keys).agg(
        F.avg("held_before").alias("exposure"),
        (F.max_by("close", F.col(s.ts)) / F.min_by("close", F.col(s.ts))).alias("__q"),
    )
    q = F.col("__q")
    kept = (1 - FEE) ** 2 * (1 - SLIP) / (1 + SLIP)
    drift, drift_net = F.col("exposure") * (q - 1), F.col("exposure") * (kept * q - 1)
    return own.join(market, list(s.keys)).withColumns(
        {
            "drift_gross": drift,
            "timing_gross": F.col("gross") - drift,
            "timing_net": F.col("net") - drift_net + F.col("friction"),
        }
    ).drop("__q")
