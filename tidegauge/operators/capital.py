"""Capital protection over dated equity rows.

High-water mark and locked profit only grow, so they are running maxima.  The
reserve follows from them row by row; only periodic harvests depend on earlier
harvests, and run as an ordered fold in time slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.fold import sliced_fold
from tidegauge.plans.series import Series, running

PERIOD_MS = {"hourly": 3_600_000, "daily": 86_400_000, "weekly": 7 * 86_400_000, "always": 0}  # fixed values
EPS = 1e-9


def protection(rows: DataFrame, s: Series, core: float, lock: float = 0.5, buffer_pct: float = 0.0) -> DataFrame:
    """Equity, high-water mark, locked profit, threshold and status per row."""
    e = rows.withColumn("equity", F.lit(core) + F.col("realised") + F.col("unrealised"))
    e = running(e, s, {"high_water": ("max", "equity")}).withColumn("high_water", F.greatest("high_water", F.lit(core)))
    locked = F.greatest(F.lit(0.0), F.col("high_water") - core) * lock
    threshold = (F.lit(core) + F.col("locked")) * (1 - buffer_pct / 100)
    out = e.withColumn("locked", locked).withColumn("threshold", threshold)
    eq = F.col("equity")
    return out.withColumns(
        {
            "distance": eq - F.col("threshold"),
            "status": F.when(eq >= F.col("threshold"), "protected").when(eq < core, "at_risk").otherwise("watch"),
            "net_positive": eq > core,
        }
    )


def _next_harvest(realised: np.ndarray, begin: int, last: float, least: float) -> int:
    """First row from ``begin`` whose gain over the last harvest is positive and large enough; looked for in growing steps."""
    step = 64
    while begin < len(realised):
        gain = realised[begin : begin + step] - last
        good = np.flatnonzero((gain > 0) & (gain >= least))
        if len(good):
            return begin + int(good[0])
        begin, step = begin + step, 2 * step
    return len(realised)


class ReserveStep:
    """One account's reserve and harvests; state is a small dict, work is by harvest and not by row.

    A row lets the reserve x through if target < x <= cap, and else sets it to the target, the lesser of locked profit
    and cap.  Locked profit never falls, so a target below an earlier one is its own cap.  Hence rows in sequence
    act as one row with the last target and the least cap, and between harvests the reserve of every row
    follows from running minima of the cap.
    """

    def __init__(self, lock: float, harvest_ratio: float = 0.0, threshold: float = 0.0, period: str = "daily"):
        self.lock, self.ratio, self.threshold, self.period = lock, harvest_ratio, threshold, PERIOD_MS[period]

    def start(self) -> dict:
        return {"reserve": 0.0, "harvested": 0.0, "last_at": None, "last_realised": 0.0}

    def advance(self, st: dict, at: np.ndarray, realised: np.ndarray, locked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reserve and harvest of rows in order; ``st`` moves on to the last of them."""
        cap = np.maximum(realised, 0.0) * self.lock
        target = np.minimum(locked, cap)
        held, harvest = np.empty(len(at)), np.zeros(len(at))
        begin = 0
        while begin < len(at):
            due = begin if st["last_at"] is None else max(begin, int(np.searchsorted(at, st["last_at"] + self.period)))
            event = _next_harvest(realised, due, st["last_realised"], self.threshold) if self.ratio > 0 else len(at)
            part = slice(begin, min(event + 1, len(at)))
            through = (st["reserve"] > target[part]) & (st["reserve"] <= np.minimum.accumulate(cap[part]) + EPS)
            held[part] = np.where(through, st["reserve"], target[part])
            if event < len(at):
                harvest[event] = (realised[event] - st["last_realised"]) * self.ratio
                held[event] += harvest[event]
                st.update(last_at=int(at[event]), last_realised=float(realised[event]))
            st["reserve"], begin = float(held[part.stop - 1]), part.stop
        st["harvested"] += float(harvest.sum())
        return held, harvest

    def one(self, st: dict, at: int, realised: float, locked: float) -> float:
        """Advance by one dated row; returns the amount harvested on it."""
        return float(self.advance(st, np.array([at]), np.array([realised], float), np.array([locked], float))[1][0])

    def __call__(self, state: dict | None, rows: pd.DataFrame, final: bool) -> tuple[dict, pd.DataFrame]:
        st = dict(state or self.start())
        before = st["harvested"]
        at, realised, locked = (rows[c].to_numpy(t) for c, t in (("ts_ms", np.int64), ("realised", float), ("locked", float)))
        held, harvest = self.advance(st, at, realised, locked)
        return st, pd.DataFrame({"ts_ms": at, "reserve": held, "harvest": harvest, "total_harvested": before + np.cumsum(harvest)})


def reserve(protected: DataFrame, s: Series, step: ReserveStep, span: int) -> DataFrame:
    """Actual reserve and harvests per row of ``protection`` output.

    Without harvests nothing ever lifts the reserve above its target, so every row tells its own.
    """
    key = s.keys[0]
    rows = protected.select(key, s.ts, "realised", "locked", F.unix_millis(s.ts).alias("ts_ms"))
    if step.ratio <= 0:
        target = F.least("locked", F.greatest("realised", F.lit(0.0)) * step.lock)
        return rows.select(key, "ts_ms", target.alias("reserve"), F.lit(0.0).alias("harvest"), F.lit(0.0).alias("total_harvested"))
    schema = f"{key} string, ts_ms long, reserve double, harvest double, total_harvested double"
    return sliced_fold(rows, [key], s.ts, ["ts_ms"], span, step, schema)


def capital_view(protected: DataFrame, reserves: DataFrame, key: str, core: float) -> DataFrame:
    """Full view: protection plus reserve, trading capital and unharvested profit."""
    j = protected.withColumn("ts_ms", F.unix_millis("ts")).join(reserves, [key, "ts_ms"])
    loose = F.col("realised") - F.col("total_harvested")
    return j.withColumns(
        {
            "unharvested": F.greatest(F.lit(0.0), loose),
            "trading_capital": F.lit(core) + F.greatest(F.lit(0.0), loose),
            "equity_vs_core_pct": (F.col("equity") / core - 1) * 100,
        }
    )
