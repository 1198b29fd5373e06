"""Merge-sort trees and pair moments against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import features
from tidegauge.operators.order_stats import pair_correlation, trailing_counts, window_ranks
from tidegauge.plans.series import Series


@pytest.mark.parametrize("rows,n,values", [(0, 5, 3), (1, 1, 3), (300, 1, 5), (300, 7, 5), (1000, 64, 10**6), (3000, 2016, 40)])
def test_trailing_counts(rows, n, values):
    x = np.random.default_rng(rows + n).integers(0, values, rows).astype(float)
    less, most = trailing_counts(x, n)
    for t in range(rows):
        held = x[max(0, t - n + 1) : t + 1]
        assert less[t] == (held < x[t]).sum() and most[t] == (held <= x[t]).sum()


@pytest.mark.parametrize("size", [None, 11])
def test_window_ranks_with_nulls(spark, size):
    rng = np.random.default_rng(5)
    rows = [(k, i, None if rng.random() < 0.03 else float(rng.integers(0, 9))) for k in "ab" for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, ts long, x double").withColumn("ts", F.timestamp_seconds("ts"))
    got = {(r.symbol, r.ts.timestamp()): (r.le, r.avg) for r in window_ranks(df, Series(span=20), 10, {"le": "x"}, {"avg": "x"}, size=size).collect()}
    assert len(got) == len(rows)
    for k in "ab":
        x = [r[2] for r in rows if r[0] == k]
        for i in range(90):
            held = x[max(0, i - 9) : i + 1]
            le, avg = got[k, i]
            if len(held) < 10 or None in held:
                assert le is None and avg is None
            else:
                less, most = sum(v < x[i] for v in held), sum(v <= x[i] for v in held)
                assert le == pytest.approx(most / 10) and avg == pytest.approx((less + (most - less + 1) / 2) / 10)


def test_pair_correlation():
    rng = np.random.default_rng(6)
    r = rng.normal(1e-3, 1e-2, (400, 30)) + rng.normal(0, 1e-2, (400, 1))
    r[100, 3] = np.nan
    r[250:, 5] = 0.01  # constant over whole windows from here on
    got = pair_correlation(r, 60)
    for t in range(400):
        held = r[t - 59 : t + 1] if t >= 59 else None
        if held is None or np.isnan(held).any() or t >= 309:
            assert np.isnan(got[t])
        else:
            c = np.corrcoef(held.T)
            assert got[t] == pytest.approx(c[np.triu_indices(30, 1)].mean(), abs=1e-9)


def test_pair_plan_does_not_grow_with_symbols(spark):
    def plan(k):
        rows = [(f"x{j}", i * 3600, 1.0 + j + (i * (j + 3)) % 7) for j in range(k) for i in range(6)]
        bars = spark.createDataFrame(rows, "symbol string, ts long, close double").withColumn("ts", F.timestamp_seconds("ts"))
        return features.mean_pairwise_corr(bars, Series(span=86_400), 3600, 3)._jdf.queryExecution().analyzed().toString().count("\n")

    assert plan(2) == plan(9)


def test_reached_against_loop():
    from tidegauge.operators.positions import Reached

    rng = np.random.default_rng(2)
    for rows in (0, 1, 2, 7, 64, 300):
        low, high, marked = rng.normal(-1, 1, rows), rng.normal(1, 1, rows), rng.random(rows) < 0.01
        tree = Reached(low, high, marked)
        start = rng.integers(0, max(rows, 1), 200)
        floor, ceiling = rng.normal(-3, 1, 200), rng.normal(3, 1, 200)
        floor[:20] = ceiling[:20] = np.nan  # an entry without a price meets marks only
        got = tree.first(start, floor, ceiling)
        for i in range(200):
            hits = [j for j in range(start[i], rows) if low[j] <= floor[i] or high[j] >= ceiling[i] or marked[j]]
            assert got[i] == (hits[0] if hits else 1 << tree.levels)


@pytest.mark.parametrize("piece", [50, 10_000])
def test_first_barrier_against_loop(spark, piece):
    from tidegauge.operators.positions import first_barrier

    rng = np.random.default_rng(7)
    rows = []
    for key in "ab":
        price = 100.0
        for i in range(120):
            price *= 1 + rng.normal(0, 0.02)
            rows.append((key, i * 10, price * 0.99 if i % 17 else None, price * 1.01, price, int(rng.random() < 0.02)))
    path = spark.createDataFrame(rows, "symbol string, s long, low double, high double, close double, exit_flag int").withColumn("ts", F.timestamp_seconds("s"))
    ent = path.selectExpr("symbol", "ts AS entry_at", "close AS entry_price")
    got = {(r.symbol, r.entry_at.timestamp()): r for r in first_barrier(ent, path, ["symbol"], 0.05, 0.08, 300, piece).collect()}
    for key, s, _, _, p, _ in rows:
        later = [r for r in rows if r[0] == key and s < r[1] <= s + 300]
        if not later:
            assert (key, s) not in got
            continue
        for _, at, low, high, close, flag in later:
            if low is not None and low <= p * 0.95:
                want = at, p * 0.95, "stop_loss"
            elif high >= p * 1.08:
                want = at, p * 1.08, "roi"
            elif flag:
                want = at, close, "exit_signal"
            else:
                continue
            break
        else:
            want = later[-1][1], later[-1][4], "force_exit"
        r = got[key, s]
        assert (r.exit_at.timestamp(), r.exit_price, r.exit_reason) == (want[0], pytest.approx(want[1]), want[2])
