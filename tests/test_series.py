"""Chunked ordered operators: results do not depend on chunk or block size."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import indicators, joins, positions, windows as w
from tidegauge.plans import series as S


@pytest.fixture(scope="module")
def walk(spark):
    """A hot key with most rows, a small key, gaps, and a burst inside one second."""
    rng = np.random.default_rng(0)
    rows = []
    for key, n in (("hot", 900), ("cold", 37)):
        gaps = rng.choice([60, 300, 7200], n, p=[0.6, 0.3, 0.1]).cumsum()
        px = 100 + rng.normal(0, 1, n).cumsum()
        for g, p in zip(gaps, px):
            rows.append((key, pd.Timestamp("2024-01-01") + pd.Timedelta(int(g), "s"), float(p), float(p + abs(rng.normal())), float(p - abs(rng.normal()))))
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "close", "high", "low"])
    return pdf, spark.createDataFrame(pdf)


def series(span):
    return S.Series(("symbol",), "ts", (), span)


def by_key(df, *cols):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)[list(cols)]


@pytest.mark.parametrize("span", [60, 3600, 10**7])
def test_positions(walk, span):
    pdf, df = walk
    got = by_key(S.number_rows(df, series(span), total="n"), "pos", "n")
    want = pdf.sort_values(["symbol", "ts"]).groupby("symbol").cumcount()
    assert (got["pos"].to_numpy() == want.to_numpy()).all()
    assert set(got["n"]) == {900, 37}


@pytest.mark.parametrize("span", [60, 3600, 10**7])
def test_running(walk, span):
    pdf, df = walk
    d = df.withColumn("odd", F.when(F.col("close") > 100, F.col("close")))
    parts = {"s": ("sum", "close"), "m": ("max", "close"), "l": ("last", "odd"), "b": ("last", "odd", "before"), "k": ("count", "odd")}
    got = by_key(S.running(d, series(span), parts), "s", "m", "l", "b", "k")
    g = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    g["odd"] = g["close"].where(g["close"] > 100)
    k = g.groupby("symbol")
    np.testing.assert_allclose(got["s"], k["close"].cumsum())
    np.testing.assert_allclose(got["m"], k["close"].cummax())
    np.testing.assert_allclose(got["l"].astype(float), k["odd"].ffill())
    np.testing.assert_allclose(got["b"].astype(float), k["odd"].ffill().groupby(g["symbol"]).shift(1))


@pytest.mark.parametrize("span", [600, 10**7])
@pytest.mark.parametrize("start", [None, 50.0])
def test_running_equity(walk, span, start):
    pdf, df = walk
    d = df.withColumn("pnl", F.col("close") - 100)
    got = by_key(S.running_equity(d, series(span), "pnl", start), "equity", "peak")
    g = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    eq = (g["close"] - 100).groupby(g["symbol"]).cumsum() + (start or 0.0)
    peak = eq.groupby(g["symbol"]).cummax()
    np.testing.assert_allclose(got["equity"], eq)
    np.testing.assert_allclose(got["peak"], peak if start is None else np.maximum(peak, start))


@pytest.mark.parametrize("size", [16, 64, 4096])
def test_framed_blocks(walk, size):
    pdf, df = walk

    def build(d, b):
        return d.withColumns({"m": w.sma(b, F.col("close"), 10), "f": w.forward_return(b, F.col("close"), 5)})

    got = by_key(S.framed(df, series(3600), build, back=10, ahead=5, size=size), "m", "f")
    g = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    k = g.groupby("symbol")["close"]
    np.testing.assert_allclose(got["m"].astype(float), k.transform(lambda x: x.rolling(10).mean()))
    np.testing.assert_allclose(got["f"].astype(float), k.transform(lambda x: x.shift(-5) / x - 1))


def test_ewm_exact_across_blocks(walk):
    """The weighted-sum form equals the recursion to double precision in every block."""
    pdf, df = walk

    def build(d, b):
        return d.withColumn("e", S.ewm(b, F.col("close"), 0.6))

    back = S.memory(0.6)
    got = by_key(S.framed(df, series(3600), build, back=back, size=100), "e")
    g = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = g.groupby("symbol")["close"].transform(lambda x: x.ewm(alpha=0.4, adjust=False).mean())
    np.testing.assert_allclose(got["e"].astype(float), want, rtol=1e-12)


def test_block_size_guard():
    assert S.block_size([13 / 14], 1200) > 0
    with pytest.raises(ValueError):
        S.block_size([0.05], 400)


@pytest.mark.parametrize("span", [60, 7200, 10**7])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_against_pandas(spark, walk, span, direction):
    pdf, df = walk
    rng = np.random.default_rng(1)
    right = pdf.sample(60, random_state=2)[["symbol", "ts"]].copy()
    right.loc[right.index[:30], "ts"] += pd.Timedelta("0.5ms")
    right["v"] = rng.normal(size=len(right))
    right = right.drop_duplicates(["symbol", "ts"])
    out = joins.asof(df.select("symbol", "ts"), spark.createDataFrame(right), series(span), ["v"], direction)
    got = out.toPandas().sort_values(["ts", "symbol"]).reset_index(drop=True)
    want = pd.merge_asof(pdf[["symbol", "ts"]].sort_values("ts"), right.sort_values("ts"), on="ts", by="symbol", direction=direction)
    want = want.sort_values(["ts", "symbol"]).reset_index(drop=True)
    np.testing.assert_allclose(got["v"].astype(float), want["v"])


def test_interval_sum_bounds(spark):
    """Open at the event, closed at the horizon."""
    ev = spark.createDataFrame([("a", datetime(2024, 1, 1), 1)], "symbol string, ts timestamp, id int")
    fl = spark.createDataFrame(
        [("a", datetime(2024, 1, 1, 0, 0, 0), 1.0), ("a", datetime(2024, 1, 1, 0, 0, 1), 2.0),
         ("a", datetime(2024, 1, 1, 1, 0, 0), 4.0), ("a", datetime(2024, 1, 1, 1, 0, 1), 8.0)],
        "symbol string, ts timestamp, x double",
    )
    out = joins.interval_sum(ev, fl, series(600), "x", 3600, ["id"], "paid").first()
    assert out["paid"] == 6.0 and out["paid_n"] == 2


def test_overlapping_intervals(spark):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    iv = spark.createDataFrame([("a", t(0), t(10)), ("a", t(1), t(2))], "symbol string, a timestamp, b timestamp")
    ev = spark.createDataFrame([("a", t(5)), ("a", t(10)), ("a", t(0))], "symbol string, ts timestamp")
    got = joins.inside_intervals(ev, iv, series(3600), "a", "b", "inside").orderBy("ts").toPandas()["inside"].tolist()
    assert got == [True, True, False]


def _loop_ledger(actions, closes, fee=0.001, slip=0.0005):
    eq, pos, out = 100.0, None, []
    for i, (a, c) in enumerate(zip(actions, closes)):
        if pos is None and a == 1:
            pos = (i, c, eq)
        elif pos is not None and a == 2:
            out.append((*pos, i, c))
            i0, c0, st = pos
            eq += st * (1 - fee) / (c0 * (1 + slip)) * c * (1 - slip) * (1 - fee) - st
            pos = None
    if pos is not None:
        out.append((*pos, len(closes) - 1, closes[-1]))
    return out


def test_ledger_toy_actions(spark):
    n = 100
    closes = [100 + 0.1 * i for i in range(n)]
    acts = [0] * n
    for i in (0, 20, 40, 60, 80, 5):
        acts[i] = 1
    for i in (10, 30, 50, 70, 95):
        acts[i] = 2
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="5min"), "close": closes, "action": acts})
    t = positions.track(spark.createDataFrame(pdf), series(1800))
    led = positions.ledger(t, series(1800)).orderBy("trade").toPandas()
    want = _loop_ledger(acts, closes)
    assert len(led) == len(want)
    np.testing.assert_allclose(led["stake"], [x[2] for x in want])
    np.testing.assert_allclose(led["close_price"], [x[4] for x in want])
    ident = led["gross"] - led["fee"] - led["slippage"]
    assert (abs(ident - led["net"]) < 0.05).all()


def test_open_position_is_forced_closed(spark):
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=5, freq="1h"), "close": [1.0, 2, 3, 4, 5], "action": [0, 1, 0, 0, 0]})
    led = positions.ledger(positions.track(spark.createDataFrame(pdf), series(3600)), series(3600)).first()
    assert led["forced"] and led["close_price"] == 5.0 and led["trade"] == 1


def test_rsi_dialects(walk):
    pdf, df = walk
    g = pdf[pdf.symbol == "hot"].sort_values("ts")
    diff = g["close"].diff()
    up, dn = diff.clip(lower=0), -diff.clip(upper=0)
    want = 100 - 100 / (1 + up.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / dn.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    got = indicators.rsi(df.filter("symbol = 'hot'"), series(3600), 14, "ewm").orderBy("ts").toPandas()["rsi"].astype(float)
    np.testing.assert_allclose(got, want.reset_index(drop=True), rtol=1e-9)
    assert got.first_valid_index() == 14
    with pytest.raises(ValueError):
        indicators.rsi(df, series(3600), 14, "other")


def test_no_window_over_a_whole_key(walk):
    """Data rows are never partitioned by the key alone."""
    _, df = walk
    plan = S.framed(df, series(3600), lambda d, b: d.withColumn("m", w.sma(b, F.col("close"), 5)), back=5)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    for line in text.splitlines():
        if "Window" in line and "windowspecdefinition(symbol" in line and "__chunk" not in line:
            assert "__block" in line


@pytest.mark.parametrize("flat", [3, 9000])
def test_adx_seed_after_a_flat_start(spark, flat):
    """The first movement seeds the average wherever it comes, in the first block or after it."""
    from tidegauge.operators.regime import market_regime

    rng = np.random.default_rng(1)
    px = np.concatenate([np.full(flat, 100.0), 101 + np.abs(rng.normal(0, 1, 1500)).cumsum() - np.arange(1500) * 0.6])
    hi, lo = px.copy(), px.copy()
    hi[flat:] += 0.5
    t0 = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({"symbol": "x", "ts": [t0 + pd.Timedelta(60 * i, "s") for i in range(len(px))], "close": px, "high": hi, "low": lo})
    tr = p = m = 0.0
    want, a = [], None
    for i in range(len(px)):
        up, down = (hi[i] - hi[i - 1], lo[i - 1] - lo[i]) if i else (0.0, 0.0)
        now = max(hi[i] - lo[i], abs(hi[i] - px[i - 1]), abs(lo[i] - px[i - 1])) if i else hi[i] - lo[i]
        tr, p, m = [x * 13 / 14 + y / 14 for x, y in ((tr, now), (p, up if up > down and up > 0 else 0.0), (m, down if down > up and down > 0 else 0.0))]
        if p + m > 0:
            dx = 100 * abs(p - m) / (p + m)
            a = dx if a is None else a * 13 / 14 + dx / 14
        want.append(a)
    df = spark.createDataFrame(pdf)
    for got in (indicators.adx(df, series(86_400), 14, "ewm"), market_regime(df, series(86_400))):
        got = got.toPandas().sort_values("ts")["adx"].astype(float).to_numpy()
        assert np.isnan(got[:flat]).all() and got[flat] == pytest.approx(100)
        np.testing.assert_allclose(got[flat:], want[flat:], rtol=1e-9)


@pytest.mark.parametrize("size,fan", [(None, 1024), (7, 3), (50, 1024), (1, 2)])
def test_averaged_against_recursion(spark, size, fan):
    """Late first values, nulls in between, short and long memories, whatever the blocks."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    decays = {"short": 1 / 3, "mid": 13 / 14, "long": 1 - 2 / 100_001, "none": 0.0}
    for key, late in (("a", 0), ("b", 40), ("c", 10_000)):
        y = dict.fromkeys(decays)
        for pos in range(130):
            x = float(rng.normal()) if pos >= late and rng.random() > 0.1 else None
            rows.append((key, pos, x))
            for n, d in decays.items():
                if y[n] is None or not d:
                    y[n] = x
                else:
                    y[n] = d * y[n] + (1 - d) * (x or 0.0)
                want[key, pos, n] = y[n]
    df = spark.createDataFrame(rows, "symbol string, pos long, x double").repartition(5)
    got = S.averaged(df, S.Series(), {n: ("x", d) for n, d in decays.items()}, size=size, fan=fan).collect()
    assert len(got) == len(rows)
    for r in got:
        for n in decays:
            w = want[r.symbol, r.pos, n]
            assert (r[n] is None and w is None) or r[n] == pytest.approx(w, rel=1e-9, abs=1e-12), (r, n)
