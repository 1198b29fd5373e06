"""Keyed state between micro-batches: the batch fold steps, kept in the state store.

A step sees one key's rows of a micro-batch in time order and its last state.
Input must arrive in time order between micro-batches.  A task holds the bare numbers of
one key's rows of a micro-batch; steps and results see ``SLICE`` rows at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.plans.fold import Step

SLICE = 50_000


def stateful(stream: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out_schema: str) -> DataFrame:
    """Apply a fold step per key with its state in the state store."""
    names = [p.strip().split(" ")[0] for p in out_schema.split(",")]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the key repeats in every row, so it does not stay
        rows = pd.concat([b.drop(columns=list(keys)) for b in batches], ignore_index=True)
        place = rows[list(order)].sort_values(list(order), kind="stable").index.to_numpy()
        held = json.loads(state.get[0]) if state.exists else None
        for at in range(0, len(place), SLICE):
            held, out = step(held, rows.iloc[place[at : at + SLICE]].reset_index(drop=True), False)
            for k, v in zip(keys, key):
                out[k] = v
            yield out.reindex(columns=names)
        state.update((json.dumps(held),))

    return stream.groupBy(*keys).applyInPandasWithState(
        advance, out_schema, "state string", "append", GroupStateTimeout.NoTimeout
    )


def latest_settlement(state: dict | None, rows: pd.DataFrame, final: bool) -> tuple[dict, pd.DataFrame]:
    """Carry the last settlement to each bar; a settlement at the bar's instant is visible.

    Rows of both streams come as one: ``side`` 0 for settlements, 1 for bars.
    """
    st = state or {"rate": None, "at": None}
    change = rows["side"].to_numpy() == 0
    at = np.maximum.accumulate(np.where(change, np.arange(len(rows)), -1))  # the settlement a row sees; -1: the carried one
    seen = at >= 0
    rate = np.where(seen, rows["rate"].to_numpy(float)[at], np.nan if st["rate"] is None else st["rate"]) if len(rows) else np.empty(0)
    micros = [int(t) if s else st["at"] for t, s in zip(rows["ts_us"].to_numpy()[at], seen)]
    if change.any():
        last = int(np.flatnonzero(change)[-1])
        st = {"rate": float(rows["rate"].iloc[last]), "at": int(rows["ts_us"].iloc[last])}
    out = pd.DataFrame({"ts_us": rows["ts_us"], "row_id": rows["row_id"], "rate": rate, "settled_us": pd.array(micros, "Int64")})[~change]
    return st, out.reset_index(drop=True)


class AccountStep:
    """High-water mark, locked profit, reserve and harvest of one account."""

    def __init__(self, core: float, reserve):
        self.core, self.reserve = core, reserve

    def __call__(self, state: dict | None, rows: pd.DataFrame, final: bool) -> tuple[dict, pd.DataFrame]:
        st = dict(state or {**self.reserve.start(), "high": self.core})
        at, realised, loose = (rows[c].to_numpy(t) for c, t in (("ts_ms", np.int64), ("realised", float), ("unrealised", float)))
        high = np.maximum.accumulate(np.concatenate([[st["high"]], self.core + realised + loose]))[1:]
        locked = np.maximum(0.0, high - self.core) * self.reserve.lock
        held, harvest = self.reserve.advance(st, at, realised, locked)
        st["high"] = float(high[-1]) if len(rows) else st["high"]
        return st, pd.DataFrame({"ts_ms": at, "high_water": high, "locked": locked, "reserve": held, "harvest": harvest})
