"""Signals to positions, positions to trade ledgers.

The position machine is a last-non-null over buy/sell codes, so it runs as a
chunked running aggregate.  Trades are position islands: the island number is a
running count of entries, and each trade is one small group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.plans.series import Series, framed, running
from tidegauge.plans.stage import materialise

FEE, SLIP = 0.001, 0.0005  # fixed values: per-side fee and slippage


def hold_state(df: DataFrame, s: Series, flip: str, out: str) -> DataFrame:
    """State after each row: the latest non-null flip (1 on, 0 off), off at first."""
    return running(df, s, {out: ("last", flip)}).withColumn(out, F.coalesce(out, F.lit(0))).drop(flip)


def hysteresis(df: DataFrame, s: Series, p: str, enter: float, leave: float, out: str) -> DataFrame:
    """On at p >= enter, off at p < leave, otherwise unchanged (enter >= leave)."""
    if enter < leave:
        raise ValueError("enter threshold below leave threshold")
    flip = F.when(F.col(p) >= enter, 1).when(F.col(p) < leave, 0)
    return hold_state(df.withColumn("__flip", flip), s, "__flip", out)


def track(df: DataFrame, s: Series, action: str = "action") -> DataFrame:
    """Long/flat machine on action codes: 1 buys when flat, 2 sells when long.

    Adds ``held_before``, ``held`` and the executed ``side`` (1, -1 or 0).
    """
    flip = F.when(F.col(action) == 1, 1).when(F.col(action) == 2, 0)
    d = running(
        df.withColumn("__flip", flip), s, {"held": ("last", "__flip"), "held_before": ("last", "__flip", "before")}
    )
    d = d.withColumns({"held": F.coalesce("held", F.lit(0)), "held_before": F.coalesce("held_before", F.lit(0))})
    return d.withColumn("side", F.col("held") - F.col("held_before")).drop("__flip")


def round_trips(tracked: DataFrame, s: Series) -> DataFrame:
    """One row per trade: buys and sells alternate, so a buy closes at the next leg.

    A position still open closes on the key's last row (``forced``).
    """
    legs = tracked.filter(F.col("side") != 0).select(*s.keys, s.ts, *s.ties, "side", "close")

    def build(d, b):
        return d.withColumns({"close_at": F.lead(s.ts).over(b.w), "close_price": F.lead("close").over(b.w)})

    opens = framed(legs, s, build, ahead=1).filter(F.col("side") == 1)
    last = tracked.groupBy(*s.keys).agg(
        F.max(s.ts).alias("__end"), F.max_by("close", F.struct(s.ts, *s.ties)).alias("__px")
    )
    return opens.join(last, list(s.keys)).select(
        *s.keys,
        F.col(s.ts).alias("open_at"),
        F.col("close").alias("open_price"),
        F.coalesce("close_at", "__end").alias("close_at"),
        F.coalesce("close_price", "__px").alias("close_price"),
        F.col("close_at").isNull().alias("forced"),
    )


def ledger(tracked: DataFrame, s: Series, stake: float = 100.0, fee: float = FEE, slip: float = SLIP) -> DataFrame:
    """Trades from tracked rows with compounding stake; open ones close on the last row.

    One row per trade: number, times, prices, stake, gross, fee, slippage, net,
    forced.  Tracked rows and trades feed several passes, so both are stored.
    """
    trades = materialise(round_trips(materialise(tracked, "tracked"), s), "trades")
    growth = (1 - fee) * (1 - fee) * (1 - slip) / (1 + slip) * F.col("close_price") / F.col("open_price")
    by_open = Series(s.keys, "open_at", (), s.span)
    grown = running(
        trades.withColumn("__g", F.ln(growth)),
        by_open,
        {"__before": ("sum", "__g", "before"), "trade": ("count", "__g")},
    )
    amount = F.col("stake") * (1 - fee) / (F.col("open_price") * (1 + slip))
    out = grown.withColumn("stake", F.lit(stake) * F.exp(F.coalesce("__before", F.lit(0.0)))).withColumn("amount", amount)
    back = F.col("amount") * F.col("close_price") * (1 - slip)
    return out.withColumns(
        {
            "gross": F.col("amount") * (F.col("close_price") - F.col("open_price")),
            "fee": F.col("stake") * fee + back * fee,
            "slippage": F.col("amount") * slip * (F.col("open_price") + F.col("close_price")),
            "net": back * (1 - fee) - F.col("stake"),
        }
    ).drop("__g", "__before", "amount")


def reentry_actions(tracked: DataFrame, s: Series) -> DataFrame:
    """Counterfactual actions: buy again on the row after every executed exit.

    The counterfactual is flat only on an exit row itself, so its codes follow
    from the executed sides of this and the previous row.
    """

    def build(d, b):
        before = F.lag("side").over(b.w)
        again = (before == -1) & (F.col("side") != -1)
        code = F.when(F.col("side") == -1, 2).when((F.col("side") == 1) | again, 1).otherwise(0)
        return d.withColumn("re_action", code)

    return framed(tracked, s, build, back=1)


class Reached:
    """First row at or after a place that falls to a lower bound, rises to an upper one, or is marked.

    Runs of 1, 2, 4, ... rows keep their least low, greatest high and whether one is marked; a search skips whole
    runs without a hit and then goes down into the first one that has it, for all askers at once.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, marked: np.ndarray):
        self.levels = max(1, int(np.ceil(np.log2(max(len(low), 1)))))
        full = 1 << self.levels
        pad = lambda x, v: np.concatenate([x, np.full(full - len(x), v, x.dtype)])
        self.tiers = [(pad(low, np.inf), pad(high, -np.inf), pad(marked, False))]
        for _ in range(self.levels):
            lo, hi, m = self.tiers[-1]
            self.tiers.append((np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), m[::2] | m[1::2]))

    def _hit(self, level: int, at: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
        lo, hi, m = (x[at >> level] for x in self.tiers[level])
        return (lo <= floor) | (hi >= ceiling) | m

    def first(self, start: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
        """Place of the first hit, or the number of places where there is none."""
        end = 1 << self.levels
        at, found = start.astype(np.int64).copy(), np.full(len(start), -1)
        for level in range(self.levels + 1):
            ask = np.flatnonzero((found < 0) & (at < end) & ((at >> level) % 2 == 1 if level < self.levels else at == 0))
            hit = self._hit(level, at[ask], floor[ask], ceiling[ask])
            found[ask[hit]] = level
            at[ask[~hit]] += 1 << level
        for level in range(self.levels - 1, -1, -1):
            ask = np.flatnonzero(found > level)
            miss = ask[~self._hit(level, at[ask], floor[ask], ceiling[ask])]
            at[miss] += 1 << level
        return np.where(found < 0, end, at)


def _exits(stop: float, target: float, horizon_s: int, keys: Sequence[str]):
    def run(entries: pa.Table, path: pa.Table) -> pa.Table:
        path = path.sort_by("micros")
        col = lambda t, c, v: t.column(c).fill_null(v).to_numpy()
        micros, close = path.column("micros").to_numpy(), path.column("close")
        tree = Reached(col(path, "low", np.inf), col(path, "high", -np.inf), path.column("mark").fill_null(0).to_numpy() == 1)
        at, price = entries.column("micros").to_numpy(), entries.column("price").cast(pa.float64()).fill_null(np.nan).to_numpy()
        begin = np.searchsorted(micros, at, "right")
        end = np.searchsorted(micros // 1_000_000, at // 1_000_000 + horizon_s, "right")
        floor, ceiling = price * (1 - stop), price * (1 + target)
        hit = tree.first(np.minimum(begin, (1 << tree.levels) - 1), floor, ceiling)
        some = np.flatnonzero(end > begin)  # entries with no later row have no exit
        inside = hit[some] < end[some]
        row = np.where(inside, hit[some], end[some] - 1)
        low, high = (path.column(c).take(pa.array(row)) for c in ("low", "high"))
        stopped = inside & (col(pa.table({"x": low}), "x", np.inf) <= floor[some])
        gained = inside & ~stopped & (col(pa.table({"x": high}), "x", -np.inf) >= ceiling[some])
        why = np.select([stopped, gained, inside], ["stop_loss", "roi", "exit_signal"], "force_exit")
        closed = close.take(pa.array(row))
        px = pa.array(np.select([stopped, gained], [floor[some], ceiling[some]], closed.fill_null(np.nan).to_numpy()), mask=~stopped & ~gained & closed.is_null().to_numpy())
        out = {k: entries.column(k).take(pa.array(some)) for k in keys}
        return pa.table({**out, "entry": pa.array(at[some]), "exit": pa.array(micros[row]), "exit_price": px, "exit_reason": pa.array(why.tolist(), pa.string())})

    return run


def first_barrier(
    entries: DataFrame, path: DataFrame, keys: Sequence[str], stop: float, target: float, horizon_s: int, piece: int = 86_400
) -> DataFrame:
    """First exit of each entry: stop, then target, then signal, on later rows.

    A task holds one key's entries of a time piece and the rows of that piece and the horizon behind it, and finds
    each entry's first hit in a hierarchy of lows and highs (``Reached``): no entry is joined to the rows it passes.
    No hit: forced at the last row inside the horizon.
    """
    span = max(piece, horizon_s)
    sec, by = F.unix_seconds("entry_at"), [*keys, "__piece"]
    asked = entries.select(*keys, F.unix_micros("entry_at").alias("micros"), F.col("entry_price").cast("double").alias("price"), F.floor(sec / span).alias("__piece"))
    at = F.unix_seconds("ts")
    rows = path.select(
        *keys, F.unix_micros("ts").alias("micros"), *[F.col(c).cast("double").alias(c) for c in ("low", "high", "close")], F.col("exit_flag").cast("int").alias("mark"),
        F.explode(F.sequence(F.floor((at - horizon_s) / span), F.floor(at / span))).alias("__piece"),
    )
    schema = T.StructType([*[entries.schema[k] for k in keys], T.StructField("entry", T.LongType()), T.StructField("exit", T.LongType()), T.StructField("exit_price", T.DoubleType()), T.StructField("exit_reason", T.StringType())])
    out = asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_exits(stop, target, horizon_s, keys), schema)
    time = F.timestamp_micros
    return out.select(*keys, time("entry").alias("entry_at"), time("exit").alias("exit_at"), "exit_price", "exit_reason")


def max_concurrent(intervals: DataFrame, s: Series, start: str, end: str, out: str = "max_open") -> DataFrame:
    """Most intervals open at once per key; an end at an instant counts before a start."""
    ends = intervals.groupBy(*s.keys, F.col(end).alias(s.ts)).agg(F.sum(F.lit(-1)).alias("d")).withColumn("o", F.lit(0))
    begins = intervals.groupBy(*s.keys, F.col(start).alias(s.ts)).agg(F.sum(F.lit(1)).alias("d")).withColumn("o", F.lit(1))
    order = Series(s.keys, s.ts, ("o",), s.span)
    level = running(ends.unionByName(begins), order, {"level": ("sum", "d")})
    return level.groupBy(*s.keys).agg(F.max("level").alias(out))


def action_class(action: Column, held_before: Column) -> Column:
    return (
        F.when(action == 0, "valid_HOLD")
        .when((action == 1) & (held_before == 0), "valid_BUY")
        .when((action == 2) & (held_before == 1), "valid_SELL")
        .when((action == 2) & (held_before == 0), "invalid_SELL_while_flat")
        .when((action == 1) & (held_before == 1), "invalid_BUY_while_long")
        .otherwise("invalid_other")
    )


def sample_flag(n: Column) -> Column:
    """Reporting flag for small samples (fixed bounds)."""
    return (
        F.when(n < 10, "EXTREME SMALL-N").when(n < 20, "VERY SMALL-N").when(n < 50, "SMALL-N").otherwise("normal")
    )
