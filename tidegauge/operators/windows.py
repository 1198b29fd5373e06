"""Column builders over haloed blocks: returns, averages, ranks, excursions.

All take a ``Blocks`` (see plans.series) and look back or ahead a fixed number
of rows.  Full windows are enforced by counting non-null values: a null in the
window gives null, and nothing is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.series import Blocks, Series, running, running_equity


def whole(b: Blocks, x: Column, n: int, value: Column) -> Column:
    """``value`` only where the N-row frame holds N non-null x."""
    return F.when(F.count(x).over(b.rows(n)) == n, value)


def sma(b: Blocks, x: Column, n: int) -> Column:
    return whole(b, x, n, F.avg(x).over(b.rows(n)))


def rolling_std(b: Blocks, x: Column, n: int) -> Column:
    return whole(b, x, n, F.stddev_samp(x).over(b.rows(n)))


def rolling_min(b: Blocks, x: Column, n: int) -> Column:
    return whole(b, x, n, F.min(x).over(b.rows(n)))


def rolling_max(b: Blocks, x: Column, n: int) -> Column:
    return whole(b, x, n, F.max(x).over(b.rows(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(b: Blocks, x: Column, k: int = 1) -> Column:
    return ratio(x, F.lag(x, k).over(b.w)) - 1


def positive_change(b: Blocks, x: Column, k: int) -> Column:
    """k-row change, null unless both ends are positive."""
    old = F.lag(x, k).over(b.w)
    return F.when((x > 0) & (old > 0), x / old - 1)


def forward_return(b: Blocks, x: Column, h: int) -> Column:
    """Return from this row to the row h later; null on the tail."""
    return ratio(F.lead(x, h).over(b.w), x) - 1


def zscore(b: Blocks, x: Column, n: int) -> Column:
    """(x - mean) / sd over N rows; null for zero spread."""
    sd = rolling_std(b, x, n)
    return F.when(sd > 0, (x - sma(b, x, n)) / sd)


def range_position(b: Blocks, x: Column, n: int) -> Column:
    """Place of x between the N-row min and max; 0.5 if flat, null in warm-up."""
    lo, hi = rolling_min(b, x, n), rolling_max(b, x, n)
    return F.when(x.isNotNull() & (hi > lo), (x - lo) / (hi - lo)).when(x.isNotNull() & (hi == lo), F.lit(0.5))


def share_at_or_below(b: Blocks, x: Column, n: int) -> Column:
    """Share of the N-row window that is <= the current value."""
    held = F.collect_list(x).over(b.rows(n))
    return F.when(F.size(held) == n, F.size(F.filter(held, lambda v: v <= x)) / F.lit(float(n)))


def average_rank_share(b: Blocks, x: Column, n: int) -> Column:
    """Average rank of the current value in its N-row window, as a share."""
    held = F.collect_list(x).over(b.rows(n))
    less = F.size(F.filter(held, lambda v: v < x))
    same = F.size(F.filter(held, lambda v: v == x))
    return F.when(F.size(held) == n, (less + (same + 1) / 2.0) / F.lit(float(n)))


def realised_vol(b: Blocks, ret: Column, n: int, per_year: float) -> Column:
    return rolling_std(b, ret, n) * F.lit(per_year**0.5)


def sign_divergence(a: Column, c: Column) -> Column:
    return F.signum(a) * F.signum(c)


def candle_shape(o: Column, h: Column, low: Column, c: Column) -> dict[str, Column]:
    """Body, wicks, close position and range; null on zero-range candles."""
    rng = F.nullif(h - low, F.lit(0.0))
    return {
        "body_ratio": F.abs(c - o) / rng,
        "up_wick_ratio": (h - F.greatest(o, c)) / rng,
        "low_wick_ratio": (F.least(o, c) - low) / rng,
        "close_pos": (c - low) / rng,
        "range_pct": rng / c,
    }


def true_range(b: Blocks, h: Column, low: Column, c: Column) -> Column:
    prev = F.lag(c).over(b.w)
    return F.greatest(h - low, F.abs(h - prev), F.abs(low - prev))


def excursions(b: Blocks, c: Column, h: int) -> tuple[Column, Column]:
    """Best and worst return over the next h rows (shorter at the end)."""
    return F.max(c).over(b.ahead(h)) / c - 1, F.min(c).over(b.ahead(h)) / c - 1


def donchian(b: Blocks, h: Column, low: Column, n: int) -> tuple[Column, Column]:
    """Channel of the N rows before the current one."""
    past = b.w.rowsBetween(-n, -1)
    full = F.count(h).over(past) == n
    return F.when(full, F.max(h).over(past)), F.when(full, F.min(low).over(past))


def vol_target_weight(sigma: Column, target: float, floor: float = 0.25, cap: float = 1.0) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(floor), F.try_divide(F.lit(target), sigma)))


def trailing_seconds(df: DataFrame, s: Series, seconds: int, sums: dict[str, str]) -> DataFrame:
    """Sums over the trailing ``seconds`` (inclusive second grid), time-ranged.

    Rows are copied into the next time piece when they can reach it, so each
    task holds one (key, piece) and never a whole key.
    """
    from pyspark.sql import Window

    piece = max(3600, 8 * seconds)
    sec = F.unix_seconds(s.ts)
    home = F.floor(sec / piece)
    reach = F.floor((sec + seconds - 1) / piece)
    spread = df.withColumn("__piece", F.explode(F.sequence(home, reach)))
    w = Window.partitionBy(*s.keys, "__piece").orderBy(sec).rangeBetween(-(seconds - 1), 0)
    out = spread.withColumns({name: F.sum(col).over(w) for name, col in sums.items()})
    return out.filter(F.col("__piece") == home).drop("__piece")


def sign_run(b: Blocks, x: Column, cap: int) -> Column:
    """Length of the current run of equal non-zero signs, capped; zero gives 0.

    A capped run needs no more history than the cap.
    """
    sign = F.signum(x)
    length, alive = F.lit(1), F.lit(True)
    for k in range(1, cap):
        alive = alive & F.coalesce(sign == F.lag(sign, k).over(b.w), F.lit(False))
        length = length + alive.cast("int")
    return F.when(x.isNull(), None).when(sign == 0, 0).otherwise(length)


def cumulative_drawdown(df: DataFrame, s: Series, pnl: str) -> DataFrame:
    """Additive equity, running peak and drawdown of a P&L column."""
    return running_equity(df, s, pnl).withColumn("drawdown", F.col("equity") - F.col("peak"))


def compounded(df: DataFrame, s: Series, ret: str, out: str = "equity") -> DataFrame:
    """Running product of (1 + return), through log sums; a total loss stays at zero."""
    parts = df.withColumns(
        {
            "__log": F.when(F.col(ret) > -1, F.log1p(F.col(ret))),
            "__dead": (F.col(ret) <= -1).cast("int"),
        }
    )
    r = running(parts, s, {"__sum": ("sum", "__log"), "__any": ("max", "__dead")})
    value = F.when(F.col("__any") == 1, F.lit(0.0)).otherwise(F.exp(F.coalesce("__sum", F.lit(0.0))))
    return r.withColumn(out, value).drop("__log", "__dead", "__sum", "__any")



def run_lengths(df: DataFrame, s: Series, col: str) -> DataFrame:
    """One row per run of equal values: key, value, run number, rows.

    Run numbers are a running count of value changes; counting is map-side.
    """
    from tidegauge.plans.series import framed

    marked = framed(
        df, s, lambda d, b: d.withColumn("__new", F.when(~F.col(col).eqNullSafe(F.lag(col).over(b.w)), 1)), back=1
    )
    numbered = running(marked, s, {"run": ("count", "__new")})
    return numbered.groupBy(*s.keys, col, "run").agg(F.count(F.lit(1)).alias("len"))
