"""Reproducible draws as plain integer arithmetic.

A draw depends only on (row id, replicate, seed): it survives retries, needs no
generator state, and any SQL engine gives the same number.  Two lanes of 31
bits mix all 64 bits of the row id first and the replicate after, so replicates
are no shifts of each other and no two row ids share their draws by rule.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647  # fixed values: prime modulus, multipliers and offsets of the two lanes
LANES = ((48271, 69621, 16807, 12345), (39373, 62089, 742938285 % 65521, 67867))
JOIN = 40692


def _int(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _mod(x: Column) -> Column:
    return F.pmod(x, F.lit(M))


def _lanes(row: Column, rep: Column | int, seed: int) -> list[Column]:
    low = _mod(_int(row))
    high = _mod(F.call_function("div", _int(row) - low, F.lit(M)))
    out = []
    for a, b, c, k in LANES:
        x = _mod(low * a + (seed * c + k) % M)
        x = _mod(_mod(x * x + k) + high * b)
        x = _mod(_mod(x * x + a) + _mod(_int(rep)) * c)
        out.append(_mod(x * x + b))
    return out


def mixed(row: Column, rep: Column | int, seed: int) -> Column:
    """Integer in [0, M) mixed from row id, replicate and seed (squares stay in 63 bits)."""
    one, two = _lanes(row, rep, seed)
    return _mod(one + two)


def uniform(row: Column, rep: Column | int, seed: int) -> Column:
    """Number in [0, 1), of 53 bits."""
    one, two = _lanes(row, rep, seed)
    return (_mod(one + two) + _mod(one * JOIN + two) / F.lit(float(M))) / F.lit(float(M))


def _folded(x: np.ndarray) -> np.ndarray:
    """``x % M`` of numbers from 0 to under 2^62: M is 2^31 - 1, so parts of 31 bits add up."""
    x = (x & M) + (x >> 31)
    x = (x & M) + (x >> 31)
    return x - M * (x >= M)


def uniform_array(row: np.ndarray, rep: np.ndarray, seed: int) -> np.ndarray:
    """``uniform`` on arrays of row ids and replicates that fit each other, for work inside tasks."""
    row, rep = np.asarray(row, np.int64), np.asarray(rep, np.int64)
    low = row % M
    high = (row - low) // M % M
    lanes = []
    for a, b, c, k in LANES:
        x = (low * a + (seed * c + k) % M) % M
        x = ((x * x + k) % M + high * b) % M
        x = _folded((x * x + a) % M + rep % M * c)
        lanes.append(_folded(x * x + b))
    one, two = lanes
    return (_folded(one + two) + _folded(one * JOIN + two) / float(M)) / float(M)


def poisson_array(u: np.ndarray, mean: int) -> np.ndarray:
    """Poisson numbers of an integer mean from uniform ones: how many cumulative probabilities each reaches."""
    low, high = poisson_span(mean)
    k = np.arange(low, high + 1)
    bounds = np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k.tolist()])))
    return low + np.searchsorted(bounds, u, side="right")


def poisson_span(mean: int) -> tuple[int, int]:
    """Least and greatest number worth a place in the table: what lies outside is rarer than a double can tell."""
    wide = 9 * math.sqrt(mean) + 20
    return max(0, math.floor(mean - wide)), math.ceil(mean + wide)


#: Cumulative Poisson(1) probabilities, up to the last that a double tells from 1.
POISSON = [p for p in accumulate(math.exp(-1) / math.factorial(k) for k in range(19)) if p < 1 - 2**-53]


def poisson_weight(row: Column, rep: Column | int, seed: int) -> Column:
    """Bootstrap weight of a row in a replicate: the number of bounds that a draw reaches."""
    u = uniform(row, rep, seed)
    return reduce(lambda x, p: x + (u >= F.lit(p)).cast("int"), POISSON, F.lit(0))


def sql_draws(source: str, row: str, rep: str, seed: int, out: str, column: str = "u") -> str:
    """The same draw as SQL text: a chain of named steps ending in table ``out``."""
    steps = [
        [f"({row}) % {M} AS m_low", f"((({row}) - ({row}) % {M}) // {M}) % {M} AS m_high", f"({rep}) % {M} AS m_rep"],
        [f"(m_low * {a} + {(seed * c + k) % M}) % {M} AS m_x{i}" for i, (a, b, c, k) in enumerate(LANES)],
        [f"((m_x{i} * m_x{i} + {k}) % {M} + m_high * {b}) % {M} AS m_y{i}" for i, (a, b, c, k) in enumerate(LANES)],
        [f"((m_y{i} * m_y{i} + {a}) % {M} + m_rep * {c}) % {M} AS m_z{i}" for i, (a, b, c, k) in enumerate(LANES)],
        [f"(m_z{i} * m_z{i} + {b}) % {M} AS m_d{i}" for i, (a, b, c, k) in enumerate(LANES)],
        [f"((m_d0 + m_d1) % {M} + ((m_d0 * {JOIN} + m_d1) % {M}) / {float(M)}::DOUBLE) / {float(M)}::DOUBLE AS {column}"],
    ]
    names = [source, *[f"{out}_{i}" for i in range(len(steps) - 1)], out]
    cast = lambda e: e if e.endswith(f" AS {column}") else f"CAST({e.split(' AS ')[0]} AS BIGINT) AS {e.split(' AS ')[1]}"
    return ", ".join(f"{to} AS (SELECT *, {', '.join(map(cast, parts))} FROM {of})" for of, to, parts in zip(names, names[1:], steps))


def sql_poisson(u: str) -> str:
    return f"len(list_filter([{', '.join(f'{p!r}::DOUBLE' for p in POISSON)}], lambda p: p <= {u}))"


def sql_poisson_of(source: str, mean: str, u: str, out: str) -> str:
    """Steps of SQL text that add ``w``, a Poisson number of the integer mean in a column, to the rows of ``source``."""
    return f"""{out}_m AS (SELECT DISTINCT {mean} AS mean, CAST(greatest(0, floor({mean} - (9 * sqrt({mean}) + 20))) AS BIGINT) AS low, CAST(ceil({mean} + 9 * sqrt({mean}) + 20) AS BIGINT) AS high FROM {source}),
      {out}_p AS (SELECT mean, low, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM {out}_m)),
      {out}_c AS (SELECT mean, max(low) AS low, list(c ORDER BY k) AS bounds FROM (SELECT *, sum(p) OVER (PARTITION BY mean ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM {out}_p) GROUP BY mean),
      {out} AS (SELECT s.*, low + len(list_filter(bounds, lambda b: b <= {u})) AS w FROM {source} s JOIN {out}_c ON {mean} = mean)"""
