"""Order and pair statistics of trailing windows, block by block.

A rank in a window of n rows by looking at all n costs n for every row.  Here a block of rows is kept as a merge-sort
tree: runs of 1, 2, 4, ... rows, each sorted.  Any window is made of two runs a level at most, and a binary search in
each tells how many of its rows are below a value, so a row costs the square of log n.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.series import Series, blocked


def trailing_counts(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many of the n rows up to it are less, and how many at most equal; fewer rows at the start."""
    values, rank = np.unique(x, return_inverse=True)
    rows, top = np.arange(len(x)), len(values)  # top fills runs that reach beyond the end: more than any value
    low, high = np.maximum(rows - n + 1, 0), rows + 1
    less, most = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    level, runs = 0, rank.astype(np.int64)
    while len(x) and (low < high).any():
        width = 1 << level
        runs = np.concatenate([runs, np.full(-len(runs) % width, top, np.int64)])
        runs = np.sort(runs.reshape(-1, width), axis=1).ravel()
        tree = runs + np.repeat(np.arange(len(runs) // width), width) * (top + 1)  # ascending over all runs
        for left in (True, False):
            use = (low < high) & ((low if left else high) % 2 == 1)
            run = low[use] if left else high[use] - 1
            key = run * (top + 1) + rank[use]
            less[use] += np.searchsorted(tree, key, "left") - run * width
            most[use] += np.searchsorted(tree, key, "right") - run * width
            if left:
                low = low + use
            else:
                high = high - use
        low, high, level = low // 2, high // 2, level + 1
    return less, most


def window_ranks(df: DataFrame, s: Series, n: int, at_most: Mapping[str, str] = {}, average: Mapping[str, str] = {}, size: int | None = None, numbered: bool = False) -> DataFrame:
    """Place of the current value among the last n rows, as a share: ``at_most`` {out: column} counts what is not above
    it, ``average`` gives its average rank.  Null where one of the n rows is."""

    def compute(table: pa.Table) -> dict[str, pa.Array]:
        out, done = {}, {}
        for name, column in [*at_most.items(), *average.items()]:
            if column not in done:  # one tree serves both ranks
                x = table.column(column).cast(pa.float64())
                valid = x.is_valid().to_numpy()
                seen = np.cumsum(valid)
                full = (seen - np.concatenate([np.zeros(n, np.int64), seen])[: len(seen)] == n) & (np.arange(len(seen)) >= n - 1)
                less, most = trailing_counts(x.fill_null(0.0).to_numpy(), n)
                done[column] = full, less, most
            full, less, most = done[column]
            share = most / n if name in at_most else (less + (most - less + 1) / 2.0) / n
            out[name] = pa.array(share, mask=~full)
        return out

    return blocked(df, s, dict.fromkeys([*at_most, *average], "double"), compute, back=n, size=size, numbered=numbered)


def pair_correlation(r: np.ndarray, n: int) -> np.ndarray:
    """Mean correlation over all pairs of columns in the n rows up to each; NaN where one is missing or constant."""
    rows, p = r.shape
    known = np.isfinite(r)
    x = np.where(known, r, 0.0)
    x = x - (x.sum(0) / np.maximum(known.sum(0), 1)) * known  # small numbers keep the running sums exact enough

    def window(v: np.ndarray) -> np.ndarray:
        c = np.cumsum(v, axis=0)
        c[n:] = c[n:] - c[:-n].copy() if len(c) > n else c[n:]
        return c

    full = window(known.all(1).astype(np.int64)) == n
    full &= np.arange(rows) >= n - 1
    mean, square = window(x) / n, window(x * x) / n
    moved = np.concatenate([np.zeros((1, p)), np.cumsum(r[1:] != r[:-1], axis=0)]) if rows else known
    flat = moved - np.concatenate([np.zeros((n - 1, p)), moved])[:rows] == 0  # no change inside the window
    spread = np.where(flat, 0.0, square - mean * mean)
    held = np.sqrt(np.where(spread > 0, spread, np.nan))
    total = np.zeros(rows)
    for i in range(p - 1):  # products of one column with those behind it: rows x p numbers at a time
        products = window(x[:, i : i + 1] * x[:, i + 1 :]) / n
        total += ((products - mean[:, i : i + 1] * mean[:, i + 1 :]) / (held[:, i : i + 1] * held[:, i + 1 :])).sum(1)
    return np.where(full, total / (p * (p - 1) / 2), np.nan)


def mean_pair_correlation(panel: DataFrame, s: Series, vector: str, n: int, size: int | None = None) -> DataFrame:
    """Adds ``mean_corr`` to rows that hold a vector of returns, one for each member, in one order everywhere."""

    def compute(table: pa.Table) -> dict[str, pa.Array]:
        r = np.array([[np.nan if v is None else v for v in row] for row in table.column(vector).to_pylist()], np.float64)
        got = pair_correlation(r.reshape(table.num_rows, -1), n)
        return {"mean_corr": pa.array(got, mask=~np.isfinite(got))}

    return blocked(panel, s, {"mean_corr": "double"}, compute, back=n, size=size)
