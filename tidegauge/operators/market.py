"""Market scan, universe choice and portfolio views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import signal_label
from tidegauge.operators import windows as w
from tidegauge.operators.features import rsi_value
from tidegauge.plans.series import POS, Series, block_size, framed, memory, number_rows, rma



def scan(bars: DataFrame, s: Series, period: int = 14) -> DataFrame:
    """Indicators and signal on the latest bar of every symbol.

    Only the rows the latest bar can depend on are kept before the window pass.
    """
    decay = 1 - 1 / period
    back = max(200, memory(decay) + period)
    numbered = number_rows(bars, s, total="__total")
    tail = numbered.filter(F.col(POS) >= F.col("__total") - back - 1)

    def build(d, b):
        diff = F.col("close") - F.lag("close").over(b.w)
        d = d.withColumns(
            {
                "__g": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))),
                "__l": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))),
                "change_1": w.change(b, F.col("close"), 1),
                "change_12": w.change(b, F.col("close"), 12),
                "__fast": w.sma(b, F.col("close"), 50),
                "__slow": w.sma(b, F.col("close"), 200),
            }
        )
        return d.withColumns({"__ag": rma(b, F.col("__g"), period, 1), "__al": rma(b, F.col("__l"), period, 1)})

    out = framed(tail, s, build, back=back, size=block_size([decay], back), numbered=True)
    last = out.filter(F.col(POS) == F.col("__total") - 1)
    last = last.withColumn("rsi", rsi_value(F.col("__ag"), F.col("__al")))
    return last.withColumn("signal", F.coalesce(signal_label(F.col("rsi"), F.col("__fast"), F.col("__slow")), F.lit("WAIT")))


def universe(tickers: DataFrame, volume: str, name: str, floor: float, n: int, pinned: Sequence[str]) -> DataFrame:
    """Top n by volume over a floor; pinned names replace the tail if they miss the cut."""
    keep = F.col(name).isin(list(pinned)) if pinned else F.lit(False)
    eligible = tickers.filter((F.col(volume) >= floor) | keep).withColumn("__pin", keep)
    # a global top-n: Spark keeps n rows per task before the last merge
    loose = eligible.orderBy(F.col("__pin").desc(), F.col(volume).desc(), name).limit(n)
    return loose.withColumn("place", F.row_number().over(Window.orderBy(F.col(volume).desc(), name))).drop("__pin")


def spot_tradable(permissions: Column, status: Column, quote: Column, name: Column, want: str, blacklist: Sequence[str]) -> Column:
    """Tradable in a spot market: nested permissions hold SPOT, right quote, not blacklisted."""
    return (
        F.array_contains(F.flatten(permissions), "SPOT")
        & (status == "TRADING")
        & (quote == want)
        & ~name.isin(list(blacklist))
    )


def open_positions(trades: DataFrame, latest: DataFrame, on: str) -> DataFrame:
    """Unrealised result at the latest price, or at the open rate without one."""
    j = trades.join(latest.select(on, "last_price"), on, "left")
    price = F.coalesce("last_price", "open_rate")
    return j.withColumn("mark", price).withColumn("unrealised", (price - F.col("open_rate")) * F.col("amount"))


def tradable_filters(stats: DataFrame, now: Column, min_age_days: int = 10, max_spread: float = 0.005,
                     min_range: float = 0.01, max_range: float = 0.9) -> DataFrame:
    """Listing age, spread and range rules over per-symbol aggregates."""
    return stats.withColumns(
        {
            "age_ok": F.datediff(now, "first_ts") >= min_age_days,
            "spread_ok": F.col("spread") <= max_spread,
            "range_ok": F.col("range").between(min_range, max_range),
        }
    )


def portfolio(trades: DataFrame, latest: DataFrame, on: str) -> DataFrame:
    """Open count, realised and unrealised result, and return on the open stake; one row."""
    marked = open_positions(trades, latest, on)
    live = F.col("is_open")
    out = marked.agg(
        F.count_if(live).alias("n_open"),
        F.coalesce(F.sum(F.when(~live, F.col("profit_abs"))), F.lit(0.0)).alias("realised"),
        F.coalesce(F.sum(F.when(live, F.col("unrealised"))), F.lit(0.0)).alias("unrealised"),
        F.sum(F.when(live, F.col("stake_amount"))).alias("staked"),
    )
    return out.withColumn("return_share", F.try_divide(F.col("realised") + F.col("unrealised"), F.col("staked")))
