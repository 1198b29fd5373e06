"""As-of, interval, nearest and offset joins, all partitioned by (key, time chunk)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.series import Series, running

SIDE = "__side"


def _stacked(left: DataFrame, right: DataFrame, s: Series, rts: str, cols: Sequence[str]) -> DataFrame:
    """Left rows and packed right rows in one ordered relation; right first on ties."""
    packed = right.select(
        *s.keys, F.col(rts).alias(s.ts), F.struct(F.col(rts).alias("__at"), *cols).alias("__r"), F.lit(0).alias(SIDE)
    )
    return left.withColumn(SIDE, F.lit(1)).unionByName(packed, allowMissingColumns=True)


def asof(
    left: DataFrame,
    right: DataFrame,
    s: Series,
    cols: Sequence[str],
    direction: str = "backward",
    right_ts: str = "ts",
    stamp: str | None = None,
) -> DataFrame:
    """Latest right row at or before (or first at or after) each left row.

    Instants compare exactly and a right row at the same instant is visible.
    One shuffle of both sides; the value standing at a chunk's start comes from
    the chunk summaries, so chunks never wait for each other.
    """
    order = Series(s.keys, s.ts, (SIDE,), s.span, reverse=direction == "forward")
    both = _stacked(left, right, order, right_ts, cols)
    hit = running(both, order, {"__hit": ("last", "__r")}).filter(F.col(SIDE) == 1).drop(SIDE, "__r")
    outs = {c: F.col(f"__hit.{c}") for c in cols}
    if stamp:
        outs[stamp] = F.col("__hit.__at")
    return hit.withColumns(outs).drop("__hit")


def nearest_gap(left: DataFrame, right: DataFrame, s: Series, out: str = "gap_ms") -> DataFrame:
    """Milliseconds to the nearest right row on either side; null if there is none."""
    both = asof(left, right, s, [], "backward", stamp="__b")
    both = asof(both, right, s, [], "forward", stamp="__f")
    at = F.unix_millis(s.ts)
    return both.withColumn(
        out, F.least(at - F.unix_millis(F.col("__b")), F.unix_millis(F.col("__f")) - at)
    ).drop("__b", "__f")


def interval_sum(
    events: DataFrame, flows: DataFrame, s: Series, amount: str, seconds: int, event_key: Sequence[str], out: str
) -> DataFrame:
    """Sum of flows with t < flow time <= t + seconds for every event.

    Prefix sums read at both ends of the interval, so cost does not depend on
    how many flows an interval holds.
    """
    start = events.withColumns({"__edge": F.lit(0), SIDE: F.lit(1)})
    stop = events.withColumns(
        {"__edge": F.lit(1), SIDE: F.lit(1), s.ts: F.col(s.ts) + F.make_dt_interval(secs=F.lit(seconds))}
    )
    flow = flows.select(*s.keys, s.ts, F.col(amount).alias("__amt"), F.lit(0).alias(SIDE))
    order = Series(s.keys, s.ts, (SIDE,), s.span)
    points = start.unionByName(stop).unionByName(flow, allowMissingColumns=True)
    total = running(points, order, {"__s": ("sum", "__amt"), "__n": ("count", "__amt")}).filter(F.col(SIDE) == 1)
    edge = F.when(F.col("__edge") == 1, 1).otherwise(-1)
    s0 = F.coalesce("__s", F.lit(0.0))
    return total.groupBy(*event_key).agg(
        F.sum(edge * s0).alias(out), F.sum(edge * F.coalesce("__n", F.lit(0))).cast("long").alias(f"{out}_n")
    )


def inside_intervals(events: DataFrame, intervals: DataFrame, s: Series, start: str, end: str, out: str) -> DataFrame:
    """True where an event lies in any half-open interval, overlapping ones included.

    The furthest end among intervals already started decides.
    """
    marks = intervals.select(*s.keys, F.col(start).alias(s.ts), F.col(end).alias("__end"), F.lit(0).alias(SIDE))
    order = Series(s.keys, s.ts, (SIDE,), s.span)
    both = events.withColumn(SIDE, F.lit(1)).unionByName(marks, allowMissingColumns=True)
    reach = running(both, order, {"__reach": ("max", "__end")}).filter(F.col(SIDE) == 1)
    return reach.withColumn(out, F.coalesce(F.col(s.ts) < F.col("__reach"), F.lit(False))).drop(SIDE, "__end", "__reach")


def at_offset(left: DataFrame, right: DataFrame, keys: Sequence[str], seconds: int, cols: Sequence[str]) -> DataFrame:
    """Exact-offset join: left row at T with the right row at T + seconds; left join."""
    moved = right.select(
        *keys, (F.col("ts") - F.make_dt_interval(secs=F.lit(seconds))).alias("ts"), *[F.col(c) for c in cols]
    )
    return left.join(moved, [*keys, "ts"], "left")


def coverage(joined: DataFrame, probe: str, keys: Sequence[str]) -> DataFrame:
    """Matched and total rows, and their ratio, per key."""
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(probe).alias("matched"),
        (F.count(probe) / F.count(F.lit(1))).alias("coverage"),
    )


def require_complete(df: DataFrame, cols: Sequence[str], what: str) -> DataFrame:
    """Fail the job on the first row where a required lookup found nothing."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    said = F.raise_error(F.lit(f"missing {what}")).cast("boolean")
    return df.filter(F.when(ok, True).otherwise(said))  # a filter: column pruning cannot drop it


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, Column | str]) -> DataFrame:
    """Left lookup with default values for misses."""
    out = left.join(right, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})
