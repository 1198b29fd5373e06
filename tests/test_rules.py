"""Guards, features, folds, capital and streaming parity."""

import io
import os
import tempfile
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import bars, capital, carry, features, joins, quality
from tidegauge.plans.fold import sliced_fold
from tidegauge.plans.series import Series
from tidegauge.sources import files, sinks
from tidegauge.streaming import live
from tidegauge.streaming.state import AccountStep, stateful

S5 = Series(("symbol",), "ts", (), 86_400)


def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="module")
def ohlcv():
    """Candles of a wave with jumps, flat stretches, equal highs and lows, and gaps in time."""
    n = 900
    k = np.arange(n)
    close = 250 + 20 * np.sin(k / 17) + 3 * np.cos(k / 3.1) + 8 * ((k // 90) % 3)
    close[300:330] = close[300]
    spread = 0.4 + 0.3 * (k % 7 > 2)
    spread[300:330] = 0.1
    open_ = np.where(k % 5 == 0, close, np.roll(close, 1))
    open_[0] = close[0]
    stamps = pd.Timestamp("2024-01-01") + pd.to_timedelta((k + 3 * (k > 500)) * 300, unit="s")
    return pd.DataFrame(
        {"symbol": "a", "ts": stamps, "open": open_, "high": np.maximum(open_, close) + spread, "low": np.minimum(open_, close) - spread, "close": close, "volume": 50.0 + 7 * (k % 11)}
    )


def test_bar_features_against_pandas(spark, ohlcv):
    got = features.bar_features(spark.createDataFrame(ohlcv), S5).orderBy("ts").toPandas()
    c, h, lo, v = (ohlcv[x] for x in ("close", "high", "low", "volume"))
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    atr = tr.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    rank = lambda x: x.rolling(288).apply(lambda z: (z <= z[-1]).mean(), raw=True)
    want = {
        "ret_72": c / c.shift(72) - 1,
        "sma200_ratio": c / c.rolling(200).mean() - 1,
        "ema26_ratio": c / c.ewm(span=26, adjust=False).mean() - 1,
        "sma50_slope": c.rolling(50).mean() / c.rolling(50).mean().shift(12) - 1,
        "ema_diff_12_26": (c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()) / c,
        "atr14_ratio": atr / c,
        "rv_12": c.pct_change().rolling(12).std() * np.sqrt(288 * 365),
        "vol_percentile_1d": rank(c.rolling(24).std()),
        "vol_rank_288": rank(atr),
        "vol_ratio_168": v / v.rolling(168).mean() - 1,
        "close_pos": (c - lo) / (h - lo),
    }
    for name, w in want.items():
        np.testing.assert_allclose(got[name].astype(float), w, rtol=1e-8, atol=1e-10, err_msg=name)
    assert got["adx14_ratio"].first_valid_index() == 26
    assert got["rsi14"].first_valid_index() == 14
    assert set(features.BLOCK_COLUMNS["B3"]) <= set(got.columns) and len(features.BLOCK_COLUMNS["B3"]) == 28


def test_missing_column_is_an_error(spark, ohlcv):
    with pytest.raises(ValueError, match="volume"):
        features.bar_features(spark.createDataFrame(ohlcv.drop(columns="volume")), S5)


def test_flat_candle_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)], "o double, h double, l double, c double")
    from tidegauge.operators.windows import candle_shape

    row = df.select(*[x.alias(n) for n, x in candle_shape(*(F.col(z) for z in "ohlc")).items()]).first()
    assert all(x is None for x in row)


def test_label_tail(spark):
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=60, freq="5min"), "close": 100.0 + np.arange(60)})
    got = features.labels(spark.createDataFrame(pdf), S5, 12, 0.003).orderBy("ts").toPandas()
    assert got["l2"].isna().sum() == 12
    assert got["l2"].iloc[0] == pytest.approx(112 / 100 - 1)


def test_resample_drops_partial(spark, ohlcv):
    d = ohlcv.head(301)
    got = bars.resample_complete(spark.createDataFrame(d), 300, 900).orderBy("ts").toPandas()
    want = d.set_index("ts").resample("15min").agg({"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"})
    assert len(got) == 100
    np.testing.assert_allclose(got[["open", "high", "low", "close", "volume"]], want.iloc[:100])


def test_guards_raise(spark, ohlcv):
    df = spark.createDataFrame(ohlcv)
    with pytest.raises(Exception, match="protected row"):
        quality.guard_protected(df, "ts", [("w", "2024-01-02", "2024-01-03")]).count() or quality.guard_protected(
            df, "ts", [("w", "2024-01-02", "2024-01-03")]
        ).agg(F.max("ts")).collect()
    with pytest.raises(Exception, match="missing exit"):
        joins.require_complete(df.withColumn("x", F.lit(None).cast("double")), ["x"], "exit").agg(F.max("x")).collect()
    with pytest.raises(ValueError):
        files.role_window(df, "final", {"train": ("2024-01-01", "2024-01-02")})


def test_pair_corr_null_spread(spark):
    rng = np.random.default_rng(0)
    n = 40
    ts = pd.date_range("2024-01-01", periods=n, freq="1h")
    m = 100 + rng.normal(0, 1, (n, 3)).cumsum(axis=0)
    long = pd.concat([pd.DataFrame({"symbol": f"x{i}", "ts": ts, "close": m[:, i]}) for i in range(3)])
    long = long[~((long.symbol == "x1") & (long.ts == ts[20]))]
    got = features.mean_pairwise_corr(spark.createDataFrame(long), S5, 3600, 6, ["x0", "x1", "x2"]).toPandas().set_index("ts")["mean_corr"]
    r = pd.DataFrame(m).pct_change()
    r.iloc[20:22, 1] = np.nan
    want = {}
    for i in range(n):
        win = r.iloc[i - 5 : i + 1] if i >= 5 else None
        if win is not None and not win.isna().any().any():
            c = win.corr().to_numpy()
            want[ts[i]] = np.mean([c[0, 1], c[0, 2], c[1, 2]])
    assert set(got.index) == set(want)
    np.testing.assert_allclose(got.sort_index(), [want[k] for k in sorted(want)])


def test_wallet_drawdown_not_ratio(spark):
    from tidegauge.operators import ledger

    d = spark.createDataFrame([("a", "2024-01-01", 0.0, 0.0), ("a", "2024-01-02", -0.30, -9.9)], "pair string, d string, profit_ratio double, profit_abs double")
    d = d.withColumn("day", F.to_date("d"))
    assert ledger.wallet_drawdown(d, ["pair"], 100.0).first()["max_dd"] == pytest.approx(-0.099)
    assert ledger.ratio_drawdown(d, ["pair"]).first()["max_dd_ratio"] == pytest.approx(-0.30)


def test_capital_reserve_needs_realised_profit():
    step = capital.ReserveStep(0.5)
    st = {**step.start(), "reserve": 0.29}
    step.one(st, 0, 0.0, 0.29)
    assert st["reserve"] == 0.0
    step.one(st, 1, 2.0, 0.29)
    assert st["reserve"] == 0.29
    step.one(st, 2, 1.0, 5.0)
    assert st["reserve"] == 0.5


@pytest.mark.parametrize("ratio,least,period", [(0.0, 0.0, "daily"), (0.3, 1.0, "daily"), (0.5, 0.0, "always"), (0.3, 4.0, "weekly")])
def test_reserve_against_row_by_row(ratio, least, period):
    rng = np.random.default_rng(9)
    for case in range(20):
        n = int(rng.integers(1, 400))
        at = np.cumsum(rng.integers(0, 3, n)) * 40_000_000
        realised = np.round(rng.normal(0.05, 3, n).cumsum(), 1)
        locked = np.maximum.accumulate(np.maximum(0, realised + rng.normal(0, 2, n))) * 0.5
        x = last = 0.0
        when, want = None, []
        for t, r, k in zip(at, realised, locked):
            cap = max(r, 0.0) * 0.5
            x = min(k, cap) if x > cap + 1e-9 else max(x, min(k, cap))
            paid = 0.0
            if ratio > 0 and r - last > 0 and r - last >= least and (when is None or t - when >= capital.PERIOD_MS[period]):
                paid, when, last = (r - last) * ratio, t, r
                x += paid
            want.append((x, paid))
        step = capital.ReserveStep(0.5, ratio, least, period)
        rows = pd.DataFrame({"ts_ms": at, "realised": realised, "locked": locked})
        cut = int(rng.integers(0, n))
        st, a = step(None, rows.iloc[:cut], False)
        st, b = step(st, rows.iloc[cut:], True)
        got = pd.concat([a, b])
        np.testing.assert_allclose(got[["reserve", "harvest"]].to_numpy(), np.array(want), atol=1e-8)
        np.testing.assert_allclose(got["total_harvested"], np.cumsum([w[1] for w in want]), atol=1e-8)


def test_fold_slices_do_not_matter(spark):
    rng = np.random.default_rng(2)
    n = 200
    pdf = pd.DataFrame({"pair": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="1D"), "realised": rng.normal(0, 5, n).cumsum(), "unrealised": rng.normal(0, 1, n)})
    df = spark.createDataFrame(pdf).withColumn("ts_ms", F.unix_millis("ts"))
    step = AccountStep(100.0, capital.ReserveStep(0.5, 0.3, 1.0, "daily"))
    schema = "pair string, ts_ms long, high_water double, locked double, reserve double, harvest double"
    runs = [sliced_fold(df, ["pair"], "ts", ["ts_ms"], span, step, schema).toPandas().sort_values("ts_ms").reset_index(drop=True) for span in (10**9, 30 * 86_400)]
    pd.testing.assert_frame_equal(runs[0], runs[1])
    assert len(runs[0]) == n


def test_flat_prices_cost_identity(spark):
    n = 600
    pdf = pd.DataFrame({"k": "q", "ts": pd.date_range("2024-01-01", periods=n, freq="1h"), "fut": 30_000.0, "spot": 30_000.0, "settle": pd.Timestamp("2025-01-01")})
    row = carry.basis_contract(spark.createDataFrame(pdf), "k", "settle").first()
    assert row["net_coin"] + row["cost_coin"] == pytest.approx(0.0, abs=1e-9)
    assert not row["breached"]


def test_stream_equals_batch_over_many_batches(spark):
    path = scratch()
    n = 60
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"pair": ["a", "b"] * (n // 2), "ts_ms": np.arange(n) * 3_600_000, "realised": rng.normal(0, 5, n).cumsum(), "unrealised": rng.normal(0, 1, n)})
    for i in range(3):
        f = f"{path}/part-{i}.parquet"
        pdf.iloc[i * 20 : (i + 1) * 20].to_parquet(f)
        os.utime(f, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    step = capital.ReserveStep(0.5, 0.3, 1.0, "daily")
    schema = spark.read.parquet(path).schema
    stream = live.read_files(spark, path, schema, per_trigger=1)
    out = stateful(stream, ["pair"], ["ts_ms"], AccountStep(100.0, step), "pair string, ts_ms long, high_water double, locked double, reserve double, harvest double")
    got = live.drain(out, "acc")[0].toPandas().sort_values("ts_ms")
    want = []
    for k, g in pdf.groupby("pair"):
        want.append(AccountStep(100.0, step)(None, g, False)[1])
    want = pd.concat(want).sort_values("ts_ms")
    for c in ("high_water", "locked", "reserve", "harvest"):
        np.testing.assert_allclose(got[c], want[c])


def test_step_sees_bounded_slices_of_a_large_batch(spark):
    path = scratch()
    for i in range(2):
        f = f"{path}/part-{i}.parquet"
        at = np.random.default_rng(i).permutation(120_000) + i * 120_000
        pd.DataFrame({"pair": "a", "ts_ms": at}).to_parquet(f)
        os.utime(f, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))

    def step(state, rows, final):
        seen = (state or {"n": 0})["n"]
        ok = bool((rows["ts_ms"].to_numpy() == seen + np.arange(len(rows))).all())
        return {"n": seen + len(rows)}, pd.DataFrame({"size": [len(rows)], "ordered": [ok], "n": [seen + len(rows)]})

    stream = live.read_files(spark, path, spark.read.parquet(path).schema, per_trigger=1)
    got = live.drain(stateful(stream, ["pair"], ["ts_ms"], step, "pair string, size long, ordered boolean, n long"), "slices")[0].toPandas()
    assert got["size"].sum() == got["n"].max() == 240_000
    assert got["size"].max() <= 50_000 and got["ordered"].all() and set(got["pair"]) == {"a"}


def test_zip_klines_and_upsert(spark):
    path = scratch()
    buf = io.StringIO("open_time,open,high,low,close,volume,ct,q,n,a,b,i\n1000,1,2,0.5,1.5,10,0,0,0,0,0,0\n2000,1,2,0.5,1.7,10,0,0,0,0,0,0\n")
    with zipfile.ZipFile(f"{path}/m.zip", "w") as z:
        z.writestr("m.csv", buf.getvalue())
    got = files.zipped_klines(spark, path).orderBy("open_ms").toPandas()
    assert got["open_ms"].tolist() == [1000, 2000] and got["close"].tolist() == [1.5, 1.7]
    table = f"{path}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(table)
    sinks.write_upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert {tuple(x) for x in spark.read.parquet(table).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_absent_ledger_is_empty(spark):
    assert files.trades_csv(spark, "/tmp/not-there-at-all").count() == 0


def test_time_conversion(spark):
    from tidegauge.functions.scalar import parse_utc, to_ms

    row = spark.range(1).select(
        to_ms(parse_utc(F.lit("2020-01-01"))).alias("naive"), to_ms(parse_utc(F.lit("2020-01-01 03:00:00"), "Europe/Istanbul")).alias("ist")
    ).first()
    assert row["naive"] == row["ist"] == 1577836800000


def test_sharpe_needs_spread(spark):
    from tidegauge.operators.ledger import returns_stats

    df = spark.createDataFrame([(0.0,), (0.0,)], "r double")
    assert df.agg(*returns_stats("r", 365)).first()["sharpe"] == 0.0
    assert df.agg(*returns_stats("r", 365, strict=True)).first()["sharpe"] is None


def test_concurrent_ends_before_starts(spark):
    from tidegauge.operators.positions import max_concurrent

    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    df = spark.createDataFrame([("a", t(0), t(2)), ("a", t(2), t(4)), ("a", t(1), t(3))], "symbol string, s timestamp, e timestamp")
    assert max_concurrent(df, Series(("symbol",), "ts", (), 3600), "s", "e").first()["max_open"] == 2
