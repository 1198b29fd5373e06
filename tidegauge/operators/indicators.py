"""Recursive indicators with both seeding dialects.

Averages of a whole history are affine scans over blocks (``plans.series.averaged``).  ``with_adx`` is the form for
callers that already hold haloed blocks: history beyond ``memory(decay)`` rows has no weight a double can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import windows as w
from tidegauge.operators.features import rsi_value
from tidegauge.plans.series import BLOCK, POS, Blocks, Series, _match as match, averaged, ewm, framed, number_rows, rma


def ema(df: DataFrame, s: Series, spans: dict[str, int], price: str = "close", keep_pos: bool = False) -> DataFrame:
    """Exponential averages 2/(span+1), started at the first value; spans of any length."""
    out = averaged(number_rows(df, s), s, {name: (price, 1 - 2 / (n + 1)) for name, n in spans.items()})
    return out if keep_pos else out.drop(POS)


def _seeded(b: Blocks, seed: str, period: int, first: int, x: Column) -> Column:
    """What ``averaged`` takes: x itself, or from position first + period - 1 with the mean so far in that place."""
    if seed == "ewm":
        return x
    if seed == "sma":
        at = F.col(POS)
        return F.when(at == first + period - 1, F.avg(x).over(b.rows(period))).when(at >= first + period, x)
    raise ValueError(f"seed must be ewm or sma, not {seed}")


def _warm(seed: str, period: int, first: int, y: str, x: str) -> Column:
    """The average from the first full period on."""
    ready = F.col(POS) >= first + period - 1
    return F.when(ready if seed == "ewm" else ready & F.col(x).isNotNull(), F.col(y))


def rsi(df: DataFrame, s: Series, period: int = 14, seed: str = "ewm") -> DataFrame:
    def build(d: DataFrame, b: Blocks) -> DataFrame:
        diff = F.col("close") - F.lag("close").over(b.w)
        d = d.withColumns(
            {"__g": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))), "__l": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0)))}
        )
        return d.withColumns({f"__x{c}": _seeded(b, seed, period, 1, F.col(f"__{c}")) for c in "gl"})

    decay = 1 - 1 / period
    d = framed(number_rows(df, s), s, build, back=period, numbered=True)
    d = averaged(d, s, {f"__a{c}": (f"__x{c}", decay) for c in "gl"})
    out = rsi_value(*[_warm(seed, period, 1, f"__a{c}", f"__{c}") for c in "gl"])
    return d.withColumn("rsi", out).drop(*[f"__{k}{c}" for k in ("", "x", "a") for c in "gl"])


def atr(df: DataFrame, s: Series, period: int = 14) -> DataFrame:
    d = framed(number_rows(df, s), s, lambda d, b: d.withColumn("__tr", w.true_range(b, F.col("high"), F.col("low"), F.col("close"))), back=1, numbered=True)
    d = averaged(d, s, {"__atr": ("__tr", 1 - 1 / period)})
    d = d.withColumn("atr", _warm("ewm", period, 0, "__atr", "__tr"))
    return d.withColumn("atr_ratio", w.ratio(F.col("atr"), F.col("close"))).drop("__tr", "__atr")


def directional(b: Blocks, d: DataFrame) -> DataFrame:
    """True range and directional movement columns."""
    up, down = F.col("high") - F.lag("high").over(b.w), F.lag("low").over(b.w) - F.col("low")
    return d.withColumns(
        {
            "__tr": w.true_range(b, F.col("high"), F.col("low"), F.col("close")),
            "__pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "__mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )


def with_adx(d: DataFrame, b: Blocks, period: int, seed: str) -> DataFrame:
    """Adds ``atr`` (same seeding) and ``adx`` on the 0..100 scale."""
    d = directional(b, d)
    xs = [F.col("__tr"), F.col("__pdm"), F.col("__mdm")]
    decay = 1 - 1 / period
    if seed == "ewm":
        t, p, m = [ewm(b, x, decay) for x in xs]
    else:
        t, p, m = [rma(b, x, period) for x in xs]
    d = d.withColumns({"atr": t, "__p": p, "__m": m})
    pdi, mdi = w.ratio(F.col("__p"), F.col("atr")), w.ratio(F.col("__m"), F.col("atr"))
    d = d.withColumn("__dx", w.ratio(100 * F.abs(pdi - mdi), pdi + mdi))
    if seed == "sma":
        return d.withColumn("adx", rma(b, F.col("__dx"), period, first=period - 1)).drop("__tr", "__pdm", "__mdm", "__p", "__m", "__dx")
    # the first movement may come late, in any block: its row is the seed.  One row per block finds it for the key,
    # as a dx that a halo copy has is never one before the series' own first.
    starts = d.groupBy(*b.keys, BLOCK).agg(F.min(F.when(F.col("__dx").isNotNull(), F.col(POS))).alias("__at"))
    starts = starts.select(*b.keys, BLOCK, F.min("__at").over(Window.partitionBy(*b.keys)).alias("__start"))
    d = match(d, starts, (*b.keys, BLOCK))
    lead = F.col(POS) == F.col("__start")
    part = F.when(lead, F.col("__dx")).when(F.col("__dx").isNotNull(), F.col("__dx") * (1 - decay))
    grow = F.pow(F.lit(1 / decay), b.step())
    return d.withColumn("__part", part).withColumn(
        "adx", F.when(F.col("__dx").isNotNull(), F.sum(F.col("__part") * grow).over(b.run) / grow)
    ).drop("__tr", "__pdm", "__mdm", "__p", "__m", "__dx", "__part", "__start")


def adx(df: DataFrame, s: Series, period: int = 14, seed: str = "sma") -> DataFrame:
    """Adds ``pos``, ``atr`` and ``adx``: averages of the movements, then of their index, each in a scan of its own."""
    decay = 1 - 1 / period
    moves = ("tr", "pdm", "mdm")

    def build(d: DataFrame, b: Blocks) -> DataFrame:
        return directional(b, d).withColumns({f"__x{c}": _seeded(b, seed, period, 0, F.col(f"__{c}")) for c in moves})

    d = framed(number_rows(df, s), s, build, back=period + 1, numbered=True)
    d = averaged(d, s, {f"__a{c}": (f"__x{c}", decay) for c in moves})
    atr_, p, m = [F.col(f"__a{c}") for c in moves]
    pdi, mdi = w.ratio(p, atr_), w.ratio(m, atr_)
    d = d.withColumn("atr", atr_).withColumn("__dx", w.ratio(100 * F.abs(pdi - mdi), pdi + mdi))
    if seed == "sma":
        d = framed(d, s, lambda d, b: d.withColumn("__xdx", _seeded(b, seed, period, period - 1, F.col("__dx"))), back=period, numbered=True)
    else:
        d = d.withColumn("__xdx", F.col("__dx"))
    d = averaged(d, s, {"__adx": ("__xdx", decay)})
    ready = F.col("__dx").isNotNull() & ((F.col(POS) >= 2 * period - 2) if seed == "sma" else F.lit(True))
    return d.withColumn("adx", F.when(ready, F.col("__adx"))).drop("__adx", "__dx", "__xdx", *[f"__{k}{c}" for k in ("", "x", "a") for c in moves])
