"""Trade-ledger analytics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import loss_ratio
from tidegauge.operators import bars
from tidegauge.plans.ranking import exact_quantiles, sent
from tidegauge.plans.stage import materialise
from tidegauge.plans.series import Series, running, running_equity


def overlap_trace(trades: DataFrame, span: int) -> DataFrame:
    """Per pair: trades, trades opened before an earlier one closed, repeated keys.

    Copies are merged first; the running furthest close decides overlap.
    """
    merged = trades.groupBy("pair", "open_date", "close_date").agg(F.count(F.lit(1)).alias("copies"))
    order = Series(("pair",), "open_date", ("close_date",), span)
    seen = running(merged, order, {"reach": ("max", "close_date")}, inclusive=False)
    return seen.groupBy("pair").agg(
        F.sum("copies").alias("n"),
        F.count_if(F.col("reach") > F.col("open_date")).alias("overlapping"),
        F.count_if(F.col("copies") > 1).alias("duplicated"),
    )


# --------------------------------------------------------------------------- summaries


def returns_stats(ret: str, per_year: float, strict: bool = False) -> list[Column]:
    """Sharpe and Sortino of a period-return column.

    Loose: 0 for zero spread, infinity without downside and a positive mean.
    Strict: null below three periods or two losing periods.
    """
    x = F.col(ret)
    mean, sd, n = F.avg(x), F.stddev_samp(x), F.count(x)
    down = F.when(x < 0, x)
    dsd, dn = F.stddev_samp(down), F.count(down)
    root = F.lit(per_year**0.5)
    if strict:
        sharpe = F.when(n < 3, None).when(sd == 0, 0.0).otherwise(F.try_divide(mean, sd) * root)
        sortino = F.when((n >= 3) & (dn >= 2) & (sd > 0) & (dsd > 0), mean / dsd * root)
    else:
        sharpe = F.when(sd > 0, mean / sd * root).otherwise(0.0)
        sortino = F.when(dsd > 0, mean / dsd * root).when(mean > 0, F.lit(float("inf"))).otherwise(0.0)
    return [sharpe.alias("sharpe"), sortino.alias("sortino")]


def profit_factor(pnl: str) -> Column:
    x = F.col(pnl)
    return loss_ratio(F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0)))


def win_rate(pnl: str) -> Column:
    return F.avg((F.col(pnl) > 0).cast("double"))


def summary(trades: DataFrame, by: Sequence[str], pnl: str = "profit_abs", ratio: str = "profit_ratio", more: Sequence[Column] = ()) -> DataFrame:
    """Counts, gross wins and losses, mean return, win rate, profit factor per group; ``more`` aggregates in the same pass."""
    x = F.col(pnl)
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("net"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("gross_win"),
        F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("gross_loss"),
        F.avg(ratio).alias("mean_ratio"),
        win_rate(pnl).alias("win_rate"),
        profit_factor(pnl).alias("profit_factor"),
        F.max(x).alias("largest_win"),
        F.min(x).alias("largest_loss"),
        *more,
    )


def trade_costs(trades: DataFrame, by: Sequence[str], fee: Column, slippage: Column, forced: Column, ratio: str = "profit_ratio") -> DataFrame:
    """``summary`` with what trading cost per group, how long the middle trade was held, and how many were closed by force."""
    minutes = trades.withColumn("__minutes", F.timestamp_diff("SECOND", F.col("open_date"), F.col("close_date")) / 60.0)
    more = [F.sum(fee).alias("fee"), F.sum(slippage).alias("slippage"), F.count_if(forced).alias("forced"), F.avg(ratio).alias("avg_ret")]
    sums = summary(trades, by, ratio=ratio, more=more)
    return sums.join(exact_quantiles(minutes, list(by), "__minutes", {"median_hold": 0.5}), list(by), "left")


def daily(trades: DataFrame, by: Sequence[str], values: Sequence[str] = ("profit_abs", "profit_ratio")) -> DataFrame:
    """Sums by close day on a zero-filled calendar per group."""
    d = trades.groupBy(*by, F.to_date("close_date").alias("day")).agg(*[F.sum(c).alias(c) for c in values])
    return bars.daily_zero_filled(d, "day", list(values), tuple(by))


NOISE = 1e-9  # of the sum of absolute values: no sum of doubles is off by as much


def day_sums(trades: DataFrame, on: Callable[[DataFrame], DataFrame], by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Sums by close day with the signs that adding row by row in ``order`` gives, whatever the tasks.

    Values of a day that cancel out come out as noise above or below zero, by the order of adding them, and count as
    a loss or not.  Only such days are added up in order, a day of a group in one task; noise does not show in others.
    ``on`` gives the trades of a table of groups and days, with the columns of ``order``.
    """
    x, key = F.col(value), [*by, "day"]
    day = F.to_date("close_date").alias("day")
    sums = materialise(trades.groupBy(*by, day).agg(F.sum(x).alias(value), F.sum(F.abs(x)).alias("__size")), "day-sums")
    unsure = materialise(sums.filter((F.abs(x) <= F.col("__size") * NOISE) & (F.col("__size") > 0)).select(*key), "unsure")
    held = F.array_sort(F.collect_list(F.struct(*order, x.cast("double").alias("__x"))))
    added = F.aggregate(held, F.lit(0.0), lambda total, row: total + row["__x"])
    signed = on(sent(unsure, len(key))).filter(x.isNotNull()).groupBy(*by, day).agg(added.alias("__added"))
    return sums.join(signed, key, "left").select(*key, F.coalesce("__added", value).alias(value))


def wallet_drawdown(days: DataFrame, by: Sequence[str], start: float, span: int = 3650 * 86_400) -> DataFrame:
    """Largest relative fall of ``start`` + summed absolute P&L, per group.

    The calendar holds one row per day, so a chunk is bounded by its span.
    """
    stamped = days.withColumn("ts", F.col("day").cast("timestamp"))
    eq = running_equity(stamped, Series(tuple(by), "ts", (), span), "profit_abs", start)
    return eq.groupBy(*by).agg(F.min(F.col("equity") / F.col("peak") - 1).alias("max_dd"))


def ratio_drawdown(days: DataFrame, by: Sequence[str], span: int = 3650 * 86_400) -> DataFrame:
    """Drawdown of the compounded ratio curve; only on explicit request."""
    from tidegauge.operators.windows import compounded

    stamped = days.withColumn("ts", F.col("day").cast("timestamp"))
    s = Series(tuple(by), "ts", (), span)
    peak = running(compounded(stamped, s, "profit_ratio", "eq"), s, {"peak": ("max", "eq")})
    return peak.groupBy(*by).agg(F.min(F.when(F.col("peak") > 0, F.col("eq") / F.col("peak") - 1)).alias("max_dd_ratio"))


def day_parts(trades: DataFrame, by: Sequence[str], **more: Column) -> DataFrame:
    """One stored row per group and close day that daily results and all totals of ``day_totals`` follow from.

    The trades are read once; ``more`` adds sums of other columns.
    """
    x, ratio = F.col("profit_abs"), F.col("profit_ratio")
    parts = trades.groupBy(*by, F.to_date("close_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("profit_abs"), F.sum(ratio).alias("profit_ratio"), F.count(x).alias("known"), F.count(ratio).alias("ratios"),
        F.count_if(x > 0).alias("wins"), F.sum(F.when(x > 0, x)).alias("won"), F.sum(F.when(x < 0, -x)).alias("lost"),
        F.max(x).alias("largest_win"), F.min(x).alias("largest_loss"), *[F.sum(c).alias(name) for name, c in more.items()],
    )
    return materialise(parts, "day-parts")


def day_totals(parts: DataFrame, by: Sequence[str], *more: str) -> DataFrame:
    """What ``summary`` says of the trades, with counts of wins and losses and the sums ``more``, from their ``day_parts``."""
    t = F.sum
    won, lost = F.coalesce(t("won"), F.lit(0.0)), F.coalesce(t("lost"), F.lit(0.0))
    losses = t("known") - t("wins")
    return parts.groupBy(*by).agg(
        t("n").alias("n"), t("profit_abs").alias("net"), won.alias("gross_win"), lost.alias("gross_loss"),
        F.try_divide(t("profit_ratio"), t("ratios")).alias("mean_ratio"), F.try_divide(t("wins"), t("known")).alias("win_rate"),
        loss_ratio(won, lost).alias("profit_factor"), F.max("largest_win").alias("largest_win"), F.min("largest_loss").alias("largest_loss"),
        t("wins").alias("wins"), losses.alias("losses"), F.try_divide(t("won"), t("wins")).alias("avg_win"), F.try_divide(-t("lost"), losses).alias("avg_loss"),
        F.try_divide(t("profit_abs"), t("known")).alias("avg_trade"), *[t(c).alias(c) for c in more],
    )


def filled(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``daily`` from ``day_parts``."""
    values = ["profit_abs", "profit_ratio"]
    return bars.daily_zero_filled(parts.select(*by, "day", *values), "day", values, tuple(by))


def window_metrics(trades: DataFrame, by: Sequence[str], start: float, fee: float = 0.001) -> DataFrame:
    """Ledger metrics of a window: daily Sharpe/Sortino, wallet drawdown, totals."""
    parts = day_parts(trades, by, volume=F.col("stake_amount"), fees=(F.col("stake_amount") * 2 + F.col("profit_abs")) * fee)
    d = materialise(filled(parts, by), "daily")
    ratios = d.groupBy(*by).agg(
        *returns_stats("profit_ratio", 365, strict=True), F.count(F.lit(1)).alias("n_days")
    )
    totals = day_totals(parts, by, "volume", "fees").drop("wins", "losses", "avg_win", "avg_loss", "avg_trade")
    return totals.join(ratios, list(by)).join(wallet_drawdown(d, by, start), list(by))


def concentration(trades: DataFrame, by: Sequence[str], pnl: str, tie: Column, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Share of the net result from the k best rows, and the rest without them.

    The k best come from a per-task top-k aggregation, never a sorted group.
    """
    k = max(ks)
    total = trades.groupBy(*by).agg(F.sum(pnl).alias("net"))
    best = top_rows(trades, by, pnl, tie, k).groupBy(*by).agg(
        *[F.sum(F.when(F.col("place") <= i, F.col(pnl))).alias(f"top{i}") for i in ks]
    )
    out = total.join(best, list(by))
    shares = {f"share_top{i}": F.try_divide(F.col(f"top{i}"), F.col("net")) for i in ks}
    rest = {f"net_ex_top{i}": F.col("net") - F.col(f"top{i}") for i in ks}
    return out.withColumns({**shares, **rest})


def top_rows(df: DataFrame, by: Sequence[str], value: str, tie: Column, k: int, salts: int = 64) -> DataFrame:
    """k largest rows per group: a salted first cut keeps k per slice, then the final k."""
    from pyspark.sql import Window

    tied = df.withColumn("__tie", tie)
    salted = tied.withColumn("__salt", F.pmod(F.xxhash64("__tie"), F.lit(salts)))
    order = [F.col(value).desc(), F.col("__tie").asc()]
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order))).filter(
        F.col("place") <= k
    )
    last = Window.partitionBy(*by).orderBy(*order)
    return first.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= k).drop("__salt", "__tie")
