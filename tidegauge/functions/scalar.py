"""Column helpers: time, strings, guards and cost formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---- time -------------------------------------------------------------------
def to_ms(ts: Column) -> Column:
    """Milliseconds since the epoch; never an integer cast of a timestamp."""
    return F.unix_millis(ts)


def parse_utc(text: Column, zone: Column | str | None = None) -> Column:
    """Text to an instant.  Naive text is UTC unless a zone is given."""
    naive = F.to_timestamp(text)
    return F.to_utc_timestamp(naive, zone) if zone is not None else naive


def iso_week(ts: Column) -> Column:
    """ISO year and week as ``2024-W01``-style key."""
    year, week = F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)
    return F.concat(year.cast("string"), F.lit("-W"), week.cast("string"))


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_seconds(b) - F.unix_seconds(a)) / 60.0


def window_bounds(text: Column) -> tuple[Column, Column]:
    """Start and end of ``a → b  # note`` text (also with ->)."""
    plain = F.trim(F.split(text, "#")[0])
    parts = F.split(plain, "\\s*(?:→|->)\\s*")
    return F.to_timestamp(parts[0]), F.to_timestamp(parts[1])


# ---- strings ----------------------------------------------------------------
def pair_to_symbol(pair: Column) -> Column:
    return F.replace(pair, F.lit("/"), F.lit(""))


def base_currency(pair: Column) -> Column:
    return F.split(pair, "/")[0]


TRENDS = ("bull", "bear")  # fixed values: regimes whose volatility suffix is left out; all others stay apart


def collapse_regime(regime: Column) -> Column:
    """Bull and bear regimes of any volatility as one each."""
    trend = F.split(regime, "_")[0]
    return F.when(trend.isin(*TRENDS), trend).otherwise(regime)


# ---- guards -----------------------------------------------------------------
def finite(x: Column) -> Column:
    """x, or null for NaN and infinities."""
    inf = float("inf")
    return F.when(~F.isnan(x) & (x != F.lit(inf)) & (x != F.lit(-inf)), x)


def positive(x: Column) -> Column:
    return F.when(finite(x) > 0, x)


def bool_text(x: Column) -> Column:
    """True/false text to boolean; anything else null."""
    t = F.lower(F.trim(x))
    return F.when(t.isin("true", "1", "t"), True).when(t.isin("false", "0", "f"), False)


def loss_ratio(gain: Column, loss: Column) -> Column:
    """gain/loss with the metric rule: infinity without losses, 0 without both."""
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


# ---- costs ------------------------------------------------------------------
def round_trip_net(stake: Column, entry: Column, exit_: Column, fee: float, slip: float) -> Column:
    amount = stake * (1 - fee) / (entry * (1 + slip))
    return amount * exit_ * (1 - slip) * (1 - fee) - stake


def inverse_contract_pnl(notional: Column, entry: Column, exit_: Column) -> Column:
    """Coin P&L of a short inverse contract."""
    return notional * (1 / exit_ - 1 / entry)


def signal_label(rsi: Column, fast: Column, slow: Column) -> Column:
    """BUY on oversold in an uptrend, SELL on overbought, else WAIT."""
    return F.when((rsi < 30) & (fast > slow), "BUY").when(rsi > 70, "SELL").otherwise("WAIT")


def bands(x: Column, edges: list[float], names: list[str], right_closed: bool = True) -> Column:
    """Named ranges; right-closed like a cut, values outside are null."""
    out = None
    for lo, hi, name in zip(edges, edges[1:], names):
        inside = ((x > lo) & (x <= hi)) if right_closed else ((x >= lo) & (x < hi))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out
