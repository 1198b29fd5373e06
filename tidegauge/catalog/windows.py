"""Bounded window features: E1-E5, E14-E17, E20-E28, E34, E35, E40, E45, E46."""

from dataclasses import replace

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SETTLEMENTS, SNAPSHOTS, TICKS, ms, query, r, rounded
from tidegauge.operators import bars, joins, windows as w
from tidegauge.operators.order_stats import window_ranks
from tidegauge.plans.series import framed
from tidegauge.sources.views import BAR_SERIES

WSQL = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def _out(df, *cols, digits=6):
    return rounded(df.select("symbol", ms("ts").alias("ts_ms"), *cols), *cols, digits=digits)


def _rd(**exprs):
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in exprs.items())


@query(
    "returns_k_bars",
    "E1 E40",
    f"""WITH {BARS} SELECT symbol, epoch_ms(ts) AS ts_ms,
      {_rd(ret_1='close / lag(close, 1) OVER w - 1', ret_3='close / lag(close, 3) OVER w - 1',
           ret_12='close / lag(close, 12) OVER w - 1', ret_72='close / lag(close, 72) OVER w - 1')} FROM nb {WSQL}""",
)
def _(v):
    ks = (1, 3, 12, 72)
    out = framed(v.bars, BAR_SERIES, lambda d, b: d.withColumns({f"ret_{k}": w.change(b, F.col("close"), k) for k in ks}), back=72)
    return _out(out, *[f"ret_{k}" for k in ks])


@query(
    "returns_guarded_positive",
    "E2",
    f"""WITH {BARS}, x AS (SELECT *, close - 110 AS v FROM nb) SELECT symbol, epoch_ms(ts) AS ts_ms,
      {_rd(chg_12='CASE WHEN v > 0 AND lag(v, 12) OVER w > 0 THEN v / lag(v, 12) OVER w - 1 END')} FROM x {WSQL}""",
)
def _(v):
    d = v.bars.withColumn("v", F.col("close") - 110)
    return _out(
        framed(d, BAR_SERIES, lambda d, b: d.withColumn("chg_12", w.positive_change(b, F.col("v"), 12)), back=12), "chg_12"
    )


@query(
    "forward_return_labels",
    "E3 C4 B7",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, lead(close, 12) OVER w / close - 1 AS f FROM nb {WSQL})
      SELECT symbol, epoch_ms(ts) AS ts_ms, round(f, 6) + 0.0 AS l2, CAST(f > 0 AS INTEGER) AS l0,
        CAST(f > 0.003 AS INTEGER) AS l1 FROM x WHERE f IS NOT NULL""",
)
def _(v):
    from tidegauge.operators.features import labels

    out = labels(v.bars, BAR_SERIES, horizon=12, cost=0.003).na.drop(subset=["l2"])
    return out.select("symbol", ms("ts").alias("ts_ms"), r("l2").alias("l2"), "l0", "l1")


def _full(fn, n):
    return f"CASE WHEN count(close) OVER r{n} = {n} THEN {fn} OVER r{n} END"


def _frames(*ns):
    return "WINDOW w AS (PARTITION BY symbol ORDER BY ts), " + ", ".join(
        f"r{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns
    )


@query(
    "sma_ratio_slope_trend",
    "E4 E5",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, close, {_full('avg(close)', 50)} AS s50, {_full('avg(close)', 200)} AS s200
        FROM nb {_frames(50, 200)})
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(sma50_ratio='close / s50 - 1', sma200_ratio='close / s200 - 1',
        sma50_slope='s50 / lag(s50, 12) OVER w - 1')}, CAST(s50 > s200 AS INTEGER) AS sma_trend FROM x {WSQL}""",
)
def _(v):
    def build(d, b):
        d = d.withColumns({"s50": w.sma(b, F.col("close"), 50), "s200": w.sma(b, F.col("close"), 200)})
        return d.withColumns(
            {
                "sma50_ratio": w.ratio(F.col("close"), F.col("s50")) - 1,
                "sma200_ratio": w.ratio(F.col("close"), F.col("s200")) - 1,
                "sma50_slope": w.change(b, F.col("s50"), 12),
                "sma_trend": (F.col("s50") > F.col("s200")).cast("int"),
            }
        )

    out = framed(v.bars, BAR_SERIES, build, back=212)
    return _out(out, "sma50_ratio", "sma200_ratio", "sma50_slope", "sma_trend").withColumn(
        "sma_trend", F.col("sma_trend").cast("int")
    )


@query(
    "rolling_std_and_vol",
    "E14",
    f"""WITH {BARS}, x AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM nb {WSQL}),
      y AS (SELECT symbol, ts, CASE WHEN count(close) OVER r24 = 24 THEN stddev_samp(close) OVER r24 END / close AS std_ratio,
        CASE WHEN count(ret) OVER r12 = 12 THEN stddev_samp(ret) OVER r12 END * sqrt(24 * 365.0) AS rv_12 FROM x {_frames(12, 24)})
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(std_ratio='std_ratio', rv_12='rv_12')} FROM y""",
)
def _(v):
    def build(d, b):
        d = d.withColumn("ret", w.change(b, F.col("close"), 1))
        return d.withColumns(
            {"std_ratio": w.rolling_std(b, F.col("close"), 24) / F.col("close"), "rv_12": w.realised_vol(b, F.col("ret"), 12, 24 * 365)}
        )

    return _out(framed(v.bars, BAR_SERIES, build, back=24), "std_ratio", "rv_12")


@query(
    "zscore_and_range_position",
    "E15 E16",
    f"""WITH {BARS}, x AS (SELECT *, CASE WHEN count(close) OVER r48 = 48 THEN avg(close) OVER r48 END AS m,
        CASE WHEN count(close) OVER r48 = 48 THEN stddev_samp(close) OVER r48 END AS sd,
        CASE WHEN count(close) OVER r48 = 48 THEN min(close) OVER r48 END AS lo,
        CASE WHEN count(close) OVER r48 = 48 THEN max(close) OVER r48 END AS hi FROM nb {_frames(48)})
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(z_48='CASE WHEN sd > 0 THEN (close - m) / sd END',
        range_48='CASE WHEN hi > lo THEN (close - lo) / (hi - lo) WHEN hi = lo THEN 0.5 END')} FROM x""",
)
def _(v):
    def build(d, b):
        return d.withColumns({"z_48": w.zscore(b, F.col("close"), 48), "range_48": w.range_position(b, F.col("close"), 48)})

    return _out(framed(v.bars, BAR_SERIES, build, back=48), "z_48", "range_48")


@query(
    "rolling_percentile_ranks",
    "E21 E22",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, close, array_agg(close) OVER r48 AS h FROM nb {_frames(48)})
      SELECT symbol, epoch_ms(ts) AS ts_ms,
       {_rd(pct_le='CASE WHEN len(h) = 48 THEN len(list_filter(h, lambda z: z <= close)) / 48.0 END',
            pct_avg='CASE WHEN len(h) = 48 THEN (len(list_filter(h, lambda z: z < close)) + (len(list_filter(h, lambda z: z = close)) + 1) / 2.0) / 48.0 END')}
      FROM x""",
)
def _(v):
    return _out(window_ranks(v.bars.select("symbol", "ts", "close"), BAR_SERIES, 48, {"pct_le": "close"}, {"pct_avg": "close"}), "pct_le", "pct_avg")


@query(
    "rolling_percentile_ranks_long",
    "E21 E22",
    f"""WITH {TICKS}, x AS (SELECT symbol, agg_id, price, array_agg(price) OVER (PARTITION BY symbol ORDER BY ts, agg_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS h FROM ticks)
      SELECT symbol, agg_id,
       {_rd(pct_le='CASE WHEN len(h) = 1000 THEN len(list_filter(h, lambda z: z <= price)) / 1000.0 END',
            pct_avg='CASE WHEN len(h) = 1000 THEN (len(list_filter(h, lambda z: z < price)) + (len(list_filter(h, lambda z: z = price)) + 1) / 2.0) / 1000.0 END')}
      FROM x""",
)
def _(v):
    from tidegauge.sources.views import TICK_SERIES

    out = window_ranks(v.ticks.select("symbol", "ts", "agg_id", "price"), replace(TICK_SERIES, span=86_400), 1000, {"pct_le": "price"}, {"pct_avg": "price"})
    return rounded(out.select("symbol", "agg_id", "pct_le", "pct_avg"), "pct_le", "pct_avg")


@query(
    "volume_ratios",
    "E26",
    f"""WITH {BARS}, x AS (SELECT *, CASE WHEN count(volume) OVER r24 = 24 THEN avg(volume) OVER r24 END AS m24,
        CASE WHEN count(volume) OVER r168 = 168 THEN avg(volume) OVER r168 END AS m168, lag(volume) OVER w AS pv
        FROM nb {_frames(24, 168)})
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(vol_z='volume / nullif(m24, 0) - 1', vol_change='volume / nullif(pv, 0) - 1',
        vol_ratio_168='volume / nullif(m168, 0) - 1')} FROM x""",
)
def _(v):
    x = F.col("volume")

    def build(d, b):
        return d.withColumns(
            {
                "vol_z": w.ratio(x, w.sma(b, x, 24)) - 1,
                "vol_change": w.change(b, x, 1),
                "vol_ratio_168": w.ratio(x, w.sma(b, x, 168)) - 1,
            }
        )

    return _out(framed(v.bars, BAR_SERIES, build, back=168), "vol_z", "vol_change", "vol_ratio_168")


@query(
    "candle_structure",
    "E27 B8",
    f"""WITH {BARS} SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(body_ratio='abs(close - open) / nullif(high - low, 0)',
      up_wick_ratio='(high - greatest(open, close)) / nullif(high - low, 0)',
      low_wick_ratio='(least(open, close) - low) / nullif(high - low, 0)',
      close_pos='(close - low) / nullif(high - low, 0)', range_pct='nullif(high - low, 0) / close')} FROM bars""",
)
def _(v):
    cols = w.candle_shape(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    return _out(v.bars.withColumns(cols), *cols)


@query(
    "sign_change_divergence",
    "E25",
    f"""WITH {BARS}, x AS (SELECT *, close - lag(close) OVER w AS dc, volume - lag(volume) OVER w AS dv FROM nb {WSQL})
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(abs_chg='abs(dc)', sgn='sign(dc)', div='sign(dc) * sign(dv)')} FROM x""",
)
def _(v):
    def build(d, b):
        dc, dv = F.col("close") - F.lag("close").over(b.w), F.col("volume") - F.lag("volume").over(b.w)
        return d.withColumns({"abs_chg": F.abs(dc), "sgn": F.signum(dc), "div": w.sign_divergence(dc, dv)})

    return _out(framed(v.bars, BAR_SERIES, build, back=1), "abs_chg", "sgn", "div")


@query(
    "same_sign_run_length",
    "E24",
    f"""WITH {SETTLEMENTS}, x AS (SELECT *, sign(rate) AS sg, row_number() OVER w - row_number() OVER
        (PARTITION BY symbol, sign(rate) ORDER BY ts) AS g FROM settlements {WSQL})
      SELECT symbol, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN sg = 0 THEN 0 ELSE
        least(8, row_number() OVER (PARTITION BY symbol, sg, g ORDER BY ts)) END AS persist FROM x""",
)
def _(v):
    out = framed(v.settlements, BAR_SERIES, lambda d, b: d.withColumn("persist", w.sign_run(b, F.col("rate"), 8)), back=8)
    return out.select("symbol", ms("ts").alias("ts_ms"), F.col("persist").cast("long").alias("persist"))


@query(
    "order_flow_imbalance_trailing",
    "E23 L3",
    f"""WITH {TICKS}, s AS (SELECT symbol, date_trunc('second', ts) AS ts,
        sum(CASE WHEN buyer_maker THEN -1.0 ELSE 1.0 END * qty * price) AS signed, sum(qty * price) AS vol FROM ticks GROUP BY 1, 2)
      SELECT symbol, epoch_ms(ts) AS ts_ms, round(sum(signed) OVER r / sum(vol) OVER r, 6) + 0.0 AS imbalance FROM s
      WINDOW r AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 3599 SECOND PRECEDING AND CURRENT ROW)""",
)
def _(v):
    out = w.trailing_seconds(bars.second_bars(v.ticks), BAR_SERIES, 3600, {"sv": "signed", "vv": "vol"})
    return _out(out.withColumn("imbalance", w.ratio(F.col("sv"), F.col("vv"))), "imbalance")


@query(
    "event_forward_returns_long",
    "E34",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, unnest([1, 3, 12, 36]) AS h, unnest([lead(close, 1) OVER w, lead(close, 3) OVER w,
        lead(close, 12) OVER w, lead(close, 36) OVER w]) / close - 1 AS ret FROM nb {WSQL})
      SELECT symbol, epoch_ms(ts) AS ts_ms, h, round(ret, 6) + 0.0 AS ret FROM x WHERE ret IS NOT NULL""",
)
def _(v):
    from tidegauge.operators.events import forward_returns

    out = forward_returns(v.bars, BAR_SERIES, (1, 3, 12, 36))
    return out.select("symbol", ms("ts").alias("ts_ms"), "h", r("ret").alias("ret"))


@query(
    "excursions_next_bars",
    "E35",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, close, max(close) OVER f / close - 1 AS mfe, min(close) OVER f / close - 1 AS mae
        FROM nb WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING))
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(mfe='mfe', mae='mae')} FROM x""",
)
def _(v):
    def build(d, b):
        up, down = w.excursions(b, F.col("close"), 24)
        return d.withColumns({"mfe": up, "mae": down})

    return _out(framed(v.bars, BAR_SERIES, build, ahead=24), "mfe", "mae")


@query(
    "donchian_long_flat",
    "E45 E29",
    f"""WITH {BARS}, x AS (SELECT *, CASE WHEN count(high) OVER p = 24 THEN max(high) OVER p END AS up,
        CASE WHEN count(high) OVER p = 24 THEN min(low) OVER p END AS dn FROM nb
        WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
      y AS (SELECT *, CASE WHEN close >= up THEN 1 WHEN close <= dn THEN 0 END AS flip FROM x)
      SELECT symbol, epoch_ms(ts) AS ts_ms, coalesce(last_value(flip IGNORE NULLS) OVER w, 0) AS state FROM y {WSQL}""",
)
def _(v):
    from tidegauge.operators.positions import hold_state

    def build(d, b):
        up, dn = w.donchian(b, F.col("high"), F.col("low"), 24)
        return d.withColumn("flip", F.when(F.col("close") >= up, 1).when(F.col("close") <= dn, 0))

    out = hold_state(framed(v.bars, BAR_SERIES, build, back=24), BAR_SERIES, "flip", "state")
    return out.select("symbol", ms("ts").alias("ts_ms"), "state")


@query(
    "vol_target_weight_turnover",
    "E46",
    f"""WITH {BARS}, x AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM nb {WSQL}),
      y AS (SELECT *, CASE WHEN count(ret) OVER r24 = 24 THEN stddev_samp(ret) OVER r24 END * sqrt(24 * 365.0) AS sigma FROM x {_frames(24)}),
      z AS (SELECT *, least(1.0, greatest(0.25, 12 / sigma)) AS wgt FROM y WHERE sigma IS NOT NULL)
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(wgt='wgt', turnover_cost='0.001 * abs(wgt - coalesce(lag(wgt) OVER w, 0))')} FROM z {WSQL}""",
)
def _(v):
    def build(d, b):
        d = d.withColumn("ret", w.change(b, F.col("close"), 1))
        d = d.withColumn("wgt", F.when(F.col("ret").isNotNull(), w.vol_target_weight(w.realised_vol(b, F.col("ret"), 24, 24 * 365), 12.0)))
        full = F.count("ret").over(b.rows(24)) == 24
        d = d.withColumn("wgt", F.when(full, F.col("wgt")))
        old = F.coalesce(F.lag("wgt").over(b.w), F.lit(0.0))
        return d.withColumn("turnover_cost", 0.001 * F.abs(F.col("wgt") - old))

    out = framed(v.bars, BAR_SERIES, build, back=50)
    return _out(out.filter(F.col("wgt").isNotNull()), "wgt", "turnover_cost")


PANEL = f"""WITH {BARS}, x AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret, close / lag(close, 12) OVER w - 1 AS r12 FROM nb {WSQL}),
      base AS (SELECT ts, r12 AS base FROM x WHERE symbol = 'S0'), rest AS (SELECT * FROM x WHERE symbol <> 'S0'), k AS (SELECT count(DISTINCT symbol) AS k FROM rest)"""


@query(
    "cross_asset_breadth_dispersion",
    "E28",
    f"""{PANEL}, a AS (SELECT ts, count(ret) AS n, count(r12) AS n12, avg(CAST(ret > 0 AS DOUBLE)) AS b1,
        avg(CAST(r12 > 0 AS DOUBLE)) AS b12, stddev_samp(r12) AS dsp, avg(r12) AS m12 FROM rest GROUP BY ts)
      SELECT epoch_ms(ts) AS ts_ms, round(CASE WHEN n = k THEN b1 END, 6) + 0.0 AS breadth_1, round(CASE WHEN n12 = k THEN b12 END, 6) + 0.0 AS breadth_12,
       round(CASE WHEN n12 = k THEN dsp END, 6) + 0.0 AS dispersion_12, round(CASE WHEN n12 = k THEN base - m12 END, 6) + 0.0 AS base_rel_12
      FROM a LEFT JOIN base USING (ts) CROSS JOIN k""",
)
def _(v):
    from tidegauge.operators.features import cross_asset

    others = [x[0] for x in v.bars.filter("symbol <> 'S0'").select("symbol").distinct().collect()]  # the assets there are
    out = cross_asset(v.bars, BAR_SERIES, base="S0", universe=others)
    cols = ("breadth_1", "breadth_12", "dispersion_12", "base_rel_12")
    return rounded(out.select(ms("ts").alias("ts_ms"), *cols), *cols)


@query(
    "base_ratio_change",
    "E28",
    f"""WITH {BARS}, p AS (SELECT a.ts, a.close / b.close AS q FROM bars a JOIN bars b USING (ts) WHERE a.symbol = 'S1' AND b.symbol = 'S0')
      SELECT epoch_ms(ts) AS ts_ms, round(q / lag(q, 12) OVER (ORDER BY ts) - 1, 6) + 0.0 AS ratio_chg_12 FROM p""",
)
def _(v):
    from tidegauge.operators.features import ratio_change

    out = ratio_change(v.bars, BAR_SERIES, "S1", "S0", 12)
    return out.select(ms("ts").alias("ts_ms"), r("ratio_chg_12").alias("ratio_chg_12"))


@query(
    "pairwise_rolling_correlation",
    "E17 C21",
    f"""WITH {BARS}, b4 AS (SELECT symbol, make_timestamp((epoch_us(ts) // 14400000000) * 14400000000) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2),
      ends AS (SELECT min(ts) AS lo, max(ts) AS hi FROM b4),
      grid AS (SELECT unnest(generate_series(lo, hi, INTERVAL 4 HOUR)) AS ts FROM ends),
      syms AS (SELECT DISTINCT symbol FROM bars),
      f AS (SELECT s.symbol, g.ts, b.close FROM grid g CROSS JOIN syms s LEFT JOIN b4 b ON b.ts = g.ts AND b.symbol = s.symbol),
      x AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret FROM f {WSQL}),
      p AS (SELECT a.symbol AS s1, b.symbol AS s2, ts, CASE WHEN b.ret IS NOT NULL THEN a.ret END AS ra,
        CASE WHEN a.ret IS NOT NULL THEN b.ret END AS rb FROM x a JOIN x b USING (ts) WHERE a.symbol < b.symbol),
      c AS (SELECT s1, s2, ts, count(ra) OVER r AS n, corr(ra, rb) OVER r AS c FROM p
        WINDOW r AS (PARTITION BY s1, s2 ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
      SELECT epoch_ms(ts) AS ts_ms, round(avg(c), 6) + 0.0 AS mean_corr FROM c GROUP BY ts HAVING min(n) = 12""",
)
def _(v):
    from tidegauge.operators.features import mean_pairwise_corr

    four = bars.resample(v.bars, 14_400)
    out = mean_pairwise_corr(four, BAR_SERIES, step=14_400, n=12)
    return out.select(ms("ts").alias("ts_ms"), r("mean_corr").alias("mean_corr"))


@query(
    "pairwise_rolling_correlation_288",
    "E17 C21",
    f"""WITH {BARS}, ends AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1),
      f AS (SELECT g.symbol, g.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS close
        FROM (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends) g LEFT JOIN bars b USING (symbol, ts)),
      x AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret FROM f {WSQL}),
      p AS (SELECT a.symbol AS s1, b.symbol AS s2, a.ts, a.ret AS ra, b.ret AS rb FROM x a JOIN x b USING (ts) WHERE a.symbol < b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL),
      c AS (SELECT s1, s2, ts, count(*) OVER r AS n, corr(ra, rb) OVER r AS c FROM p
        WINDOW r AS (PARTITION BY s1, s2 ORDER BY ts ROWS BETWEEN 287 PRECEDING AND CURRENT ROW)),
      k AS (SELECT count(DISTINCT symbol) AS k FROM bars)
      SELECT epoch_ms(ts) AS ts_ms, round(avg(c), 6) + 0.0 AS mean_corr FROM c, k GROUP BY ts, k HAVING min(n) = 288 AND count(*) = k * (k - 1) // 2""",
)
def _(v):
    from tidegauge.operators.features import mean_pairwise_corr

    hourly = bars.filled(v.bars.select("symbol", "ts", "close"), 3600, ["close"], [], BAR_SERIES)
    out = mean_pairwise_corr(hourly.select("symbol", "ts", "close"), BAR_SERIES, step=3600)
    return out.select(ms("ts").alias("ts_ms"), r("mean_corr").alias("mean_corr"))


@query(
    "compounded_equity",
    "E20",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, coalesce(close / lag(close) OVER w - 1, 0) * 0.1 AS ret FROM nb {WSQL})
      SELECT symbol, epoch_ms(ts) AS ts_ms, round(exp(sum(ln(1 + ret)) OVER w), 6) + 0.0 AS equity FROM x {WSQL}""",
)
def _(v):
    d = framed(
        v.bars, BAR_SERIES, lambda d, b: d.withColumn("ret", F.coalesce(w.change(b, F.col("close"), 1), F.lit(0.0)) * 0.1), back=1
    )
    return _out(w.compounded(d, BAR_SERIES, "ret"), "equity")


@query(
    "additive_drawdown",
    "E18 E19",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, sum(close - open) OVER w AS equity FROM nb {WSQL}),
      y AS (SELECT *, max(equity) OVER w AS peak FROM x {WSQL})
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(equity='equity', peak='peak', drawdown='equity - peak')} FROM y""",
)
def _(v):
    d = v.bars.withColumn("pnl", F.col("close") - F.col("open"))
    return _out(w.cumulative_drawdown(d, BAR_SERIES, "pnl"), "equity", "peak", "drawdown")


@query(
    "funding_settlement_features",
    "K3 E15",
    f"""WITH {BARS}, {SETTLEMENTS}, x AS (SELECT *, sign(rate) AS sg, row_number() OVER w - row_number() OVER
        (PARTITION BY symbol, sign(rate) ORDER BY ts) AS g, abs(rate - lag(rate) OVER w) AS chg,
        CASE WHEN count(rate) OVER r30 = 30 THEN stddev_samp(rate) OVER r30 END AS sd,
        avg(rate) OVER r30 AS m FROM settlements {_frames(30)}),
      y AS (SELECT symbol, ts, rate, sg, chg, CASE WHEN sd > 0 THEN (rate - m) / sd END AS z,
        CASE WHEN sg = 0 THEN 0 ELSE least(8, row_number() OVER (PARTITION BY symbol, sg, g ORDER BY ts)) END AS persist FROM x)
      SELECT b.symbol, epoch_ms(b.ts) AS ts_ms, y.rate AS fund_rate, round(z, 6) + 0.0 AS fund_z, sg AS fund_sign,
        round(chg, 9) + 0.0 AS fund_abs_chg, persist AS fund_persist FROM bars b ASOF LEFT JOIN y ON b.symbol = y.symbol AND b.ts >= y.ts""",
)
def _(v):
    from tidegauge.operators.features import funding_features

    out = funding_features(v.bars.select("symbol", "ts"), v.settlements, BAR_SERIES, window=30, cap=8)
    return out.select(
        "symbol", ms("ts").alias("ts_ms"), "fund_rate", r("fund_z").alias("fund_z"),
        (F.col("fund_sign").cast("long")).alias("fund_sign"), r("fund_abs_chg", 9).alias("fund_abs_chg"),
        F.col("fund_persist").cast("long").alias("fund_persist"),
    )


@query(
    "open_interest_features",
    "K4 B9",
    f"""WITH {BARS}, {SNAPSHOTS}, g AS (SELECT b.symbol, b.ts, b.close, s.oi FROM bars b ASOF LEFT JOIN snapshots s
        ON b.symbol = s.symbol AND b.ts >= s.ts),
      x AS (SELECT *, CASE WHEN oi > 0 AND lag(oi, 12) OVER w > 0 THEN oi / lag(oi, 12) OVER w - 1 END AS c12,
        CASE WHEN oi > 0 AND lag(oi, 1) OVER w > 0 THEN oi / lag(oi, 1) OVER w - 1 END AS c1,
        close / lag(close, 12) OVER w - 1 AS p12, count(oi) OVER r48 AS n, avg(oi) OVER r48 AS m, stddev_samp(oi) OVER r48 AS sd,
        min(oi) OVER r48 AS lo, max(oi) OVER r48 AS hi FROM g {_frames(48)})
      SELECT symbol, epoch_ms(ts) AS ts_ms, {_rd(oi_chg_12='c12', oi_chg_1='c1', oi_z='CASE WHEN n = 48 AND sd > 0 THEN (oi - m) / sd END',
        oi_price_div='sign(p12) * sign(c12)', oi_range='CASE WHEN n = 48 AND hi > lo THEN (oi - lo) / (hi - lo) WHEN n = 48 THEN 0.5 END')} FROM x""",
)
def _(v):
    from tidegauge.operators.features import open_interest_features

    out = open_interest_features(v.bars.select("symbol", "ts", "close"), v.snapshots, BAR_SERIES, window=48)
    return _out(out, "oi_chg_12", "oi_chg_1", "oi_z", "oi_price_div", "oi_range")
