"""Recursive averages and what is built on them: E6-E13, K1, K2, B15, B16, K22."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, TRADES, ms, query, r, rounded
from tidegauge.operators import indicators as ind
from tidegauge.operators.features import BLOCK_COLUMNS, bar_features
from tidegauge.operators.regime import market_regime
from tidegauge.sources.views import BAR_SERIES

WSQL = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"

# a row-by-row recursion over positions: the plain definition
DIFF = f"""{BARS}, d AS (SELECT *, close - lag(close) OVER w AS df,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr0,
    high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM nb {WSQL}),
  e AS (SELECT symbol, ts, pos, close, high, low, greatest(df, 0) AS g, greatest(-df, 0) AS l, coalesce(tr0, high - low) AS tr,
    CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM d)"""


@query(
    "ema_spans",
    "E6",
    f"""WITH RECURSIVE {BARS}, e AS (SELECT symbol, pos, close AS e12, close AS e26 FROM nb WHERE pos = 0
      UNION ALL SELECT n.symbol, n.pos, e.e12 * 11 / 13 + n.close * 2 / 13, e.e26 * 25 / 27 + n.close * 2 / 27
        FROM e JOIN nb n ON n.symbol = e.symbol AND n.pos = e.pos + 1)
      SELECT symbol, pos, round(e12, 6) + 0.0 AS ema12, round(e26, 6) + 0.0 AS ema26 FROM e""",
)
def _(v):
    out = ind.ema(v.bars, BAR_SERIES, {"ema12": 12, "ema26": 26}, keep_pos=True)
    return rounded(out.select("symbol", "pos", "ema12", "ema26"), "ema12", "ema26")


@query(
    "ema_long_spans",
    "E6",
    f"""WITH RECURSIVE {BARS}, e AS (SELECT symbol, pos, close AS a, close AS b FROM nb WHERE pos = 0
      UNION ALL SELECT n.symbol, n.pos, e.a * (1 - 2 / 4001.0::DOUBLE) + n.close * 2 / 4001, e.b * (1 - 2 / 100001.0::DOUBLE) + n.close * 2 / 100001
        FROM e JOIN nb n ON n.symbol = e.symbol AND n.pos = e.pos + 1)
      SELECT symbol, pos, round(a, 6) + 0.0 AS ema4000, round(b, 6) + 0.0 AS ema100000 FROM e""",
)
def _(v):
    out = ind.ema(v.bars, BAR_SERIES, {"ema4000": 4000, "ema100000": 100_000}, keep_pos=True)
    return rounded(out.select("symbol", "pos", "ema4000", "ema100000"), "ema4000", "ema100000")


@query(
    "rsi_ewm_seed",
    "E7 E9",
    f"""WITH RECURSIVE {DIFF}, x AS (SELECT symbol, pos, g AS ag, l AS al FROM e WHERE pos = 1
      UNION ALL SELECT n.symbol, n.pos, x.ag * 13 / 14 + n.g / 14, x.al * 13 / 14 + n.l / 14 FROM x JOIN e n ON n.symbol = x.symbol AND n.pos = x.pos + 1)
      SELECT symbol, pos, round(CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END, 6) + 0.0 AS rsi FROM x WHERE pos >= 14""",
)
def _(v):
    out = ind.rsi(v.bars, BAR_SERIES, 14, seed="ewm").filter(F.col("pos") >= 14)
    return rounded(out.select("symbol", "pos", "rsi"), "rsi")


@query(
    "rsi_sma_seed",
    "E8 E10",
    f"""WITH RECURSIVE {DIFF}, s AS (SELECT symbol, avg(g) AS ag, avg(l) AS al FROM e WHERE pos BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14),
      x AS (SELECT symbol, CAST(14 AS BIGINT) AS pos, ag, al FROM s
      UNION ALL SELECT n.symbol, n.pos, x.ag * 13 / 14 + n.g / 14, x.al * 13 / 14 + n.l / 14 FROM x JOIN e n ON n.symbol = x.symbol AND n.pos = x.pos + 1)
      SELECT symbol, pos, round(CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END, 6) + 0.0 AS rsi FROM x""",
)
def _(v):
    out = ind.rsi(v.bars, BAR_SERIES, 14, seed="sma").filter(F.col("pos") >= 14)
    return rounded(out.select("symbol", "pos", "rsi"), "rsi")


@query(
    "atr_ratio",
    "E11",
    f"""WITH RECURSIVE {DIFF}, x AS (SELECT symbol, pos, tr AS a, close FROM e WHERE pos = 0
      UNION ALL SELECT n.symbol, n.pos, x.a * 13 / 14 + n.tr / 14, n.close FROM x JOIN e n ON n.symbol = x.symbol AND n.pos = x.pos + 1)
      SELECT symbol, pos, round(a, 6) + 0.0 AS atr, round(a / close, 6) + 0.0 AS atr_ratio FROM x WHERE pos >= 13""",
)
def _(v):
    out = ind.atr(v.bars, BAR_SERIES, 14).filter(F.col("pos") >= 13)
    return rounded(out.select("symbol", "pos", "atr", "atr_ratio"), "atr", "atr_ratio")


@query(
    "adx_sma_seed",
    "E12",
    f"""WITH RECURSIVE {DIFF}, s AS (SELECT symbol, avg(tr) AS t, avg(pdm) AS p, avg(mdm) AS m FROM e WHERE pos < 14 GROUP BY 1 HAVING count(*) = 14),
      x AS (SELECT symbol, CAST(13 AS BIGINT) AS pos, t, p, m FROM s UNION ALL
        SELECT n.symbol, n.pos, x.t * 13 / 14 + n.tr / 14, x.p * 13 / 14 + n.pdm / 14, x.m * 13 / 14 + n.mdm / 14
        FROM x JOIN e n ON n.symbol = x.symbol AND n.pos = x.pos + 1),
      q AS (SELECT symbol, pos, 100 * abs(p / t - m / t) / (p / t + m / t) AS dx FROM x),
      s2 AS (SELECT symbol, avg(dx) AS a FROM q WHERE pos BETWEEN 13 AND 26 GROUP BY 1 HAVING count(*) = 14),
      y AS (SELECT symbol, CAST(26 AS BIGINT) AS pos, a FROM s2 UNION ALL
        SELECT n.symbol, n.pos, y.a * 13 / 14 + n.dx / 14 FROM y JOIN q n ON n.symbol = y.symbol AND n.pos = y.pos + 1)
      SELECT symbol, pos, round(a / 100, 6) + 0.0 AS adx FROM y""",
)
def _(v):
    out = ind.adx(v.bars, BAR_SERIES, 14, seed="sma").filter(F.col("pos") >= 26)
    return rounded(out.select("symbol", "pos", (F.col("adx") / 100).alias("adx")), "adx")


@query(
    "adx_ewm_seed",
    "E13",
    f"""WITH RECURSIVE {DIFF}, x AS (SELECT symbol, pos, tr AS t, pdm AS p, mdm AS m FROM e WHERE pos = 0 UNION ALL
        SELECT n.symbol, n.pos, x.t * 13 / 14 + n.tr / 14, x.p * 13 / 14 + n.pdm / 14, x.m * 13 / 14 + n.mdm / 14
        FROM x JOIN e n ON n.symbol = x.symbol AND n.pos = x.pos + 1),
      q AS (SELECT symbol, pos, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM x),
      f AS (SELECT symbol, min(pos) AS p0 FROM q WHERE dx IS NOT NULL GROUP BY 1),
      y AS (SELECT q.symbol, q.pos, q.dx AS a FROM q JOIN f ON q.symbol = f.symbol AND q.pos = f.p0 UNION ALL
        SELECT n.symbol, n.pos, y.a * 13 / 14 + n.dx / 14 FROM y JOIN q n ON n.symbol = y.symbol AND n.pos = y.pos + 1)
      SELECT symbol, pos, round(a, 5) + 0.0 AS adx FROM y""",
)
def _(v):
    out = ind.adx(v.bars, BAR_SERIES, 14, seed="ewm").filter(F.col("adx").isNotNull())
    return rounded(out.select("symbol", "pos", "adx"), "adx", digits=5)


@query(
    "regime_trend_volatility",
    "K2 B19 D13",
    f"""WITH RECURSIVE {DIFF}, x AS (SELECT symbol, pos, tr AS t, pdm AS p, mdm AS m FROM e WHERE pos = 0 UNION ALL
        SELECT n.symbol, n.pos, x.t * 13 / 14 + n.tr / 14, x.p * 13 / 14 + n.pdm / 14, x.m * 13 / 14 + n.mdm / 14
        FROM x JOIN e n ON n.symbol = x.symbol AND n.pos = x.pos + 1),
      q AS (SELECT symbol, pos, t, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM x),
      f AS (SELECT symbol, min(pos) AS p0 FROM q WHERE dx IS NOT NULL GROUP BY 1),
      y AS (SELECT q.symbol, q.pos, q.dx AS a FROM q JOIN f ON q.symbol = f.symbol AND q.pos = f.p0 UNION ALL
        SELECT n.symbol, n.pos, y.a * 13 / 14 + n.dx / 14 FROM y JOIN q n ON n.symbol = y.symbol AND n.pos = y.pos + 1),
      z AS (SELECT nb.symbol, nb.pos, a, CASE WHEN count(close) OVER r50 = 50 THEN avg(close) OVER r50 END AS f50,
          CASE WHEN count(close) OVER r200 = 200 THEN avg(close) OVER r200 END AS f200, array_agg(t) OVER r30 AS h, t
        FROM nb JOIN q USING (symbol, pos) LEFT JOIN y USING (symbol, pos)
        WINDOW r50 AS (PARTITION BY nb.symbol ORDER BY nb.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
          r200 AS (PARTITION BY nb.symbol ORDER BY nb.pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW),
          r30 AS (PARTITION BY nb.symbol ORDER BY nb.pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
      v AS (SELECT *, CASE WHEN len(h) = 30 THEN (len(list_filter(h, lambda k: k < t)) + (len(list_filter(h, lambda k: k = t)) + 1) / 2.0) / 30 END AS vr FROM z)
      SELECT symbol, coalesce(CASE WHEN f50 IS NULL OR f200 IS NULL OR a IS NULL OR vr IS NULL THEN NULL WHEN f50 > f200 AND a > 20 THEN 'bull'
          WHEN f50 < f200 AND a > 20 THEN 'bear' ELSE 'sideways' END || CASE WHEN vr > 0.7 THEN '_high_vol' ELSE '' END, 'unknown') AS regime, count(*) AS n
      FROM v GROUP BY 1, 2""",
)
def _(v):
    out = market_regime(v.bars, BAR_SERIES)
    return out.groupBy("symbol", F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


def _trail(*ns: int) -> str:
    return ", ".join(f"f{n} AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


def _whole(expr: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER f{n} = {n} THEN {expr} OVER f{n} END"


FEATURES_SQL = f"""WITH RECURSIVE {DIFF}, sd AS (SELECT symbol, avg(tr) AS t, avg(pdm) AS p, avg(mdm) AS m FROM e WHERE pos < 14 GROUP BY 1 HAVING count(*) = 14),
    es AS (SELECT e.*, sd.t AS st, sd.p AS sp, sd.m AS sm FROM e LEFT JOIN sd USING (symbol)),
    z AS (SELECT symbol, pos, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, tr AS atr, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS m FROM es WHERE pos = 0
      UNION ALL SELECT n.symbol, n.pos, z.e12 * 11 / 13 + n.close * 2 / 13, z.e26 * 25 / 27 + n.close * 2 / 27, CASE WHEN n.pos = 1 THEN n.g ELSE z.ag * 13 / 14 + n.g / 14 END,
        CASE WHEN n.pos = 1 THEN n.l ELSE z.al * 13 / 14 + n.l / 14 END, z.atr * 13 / 14 + n.tr / 14, CASE WHEN n.pos = 13 THEN n.st ELSE z.t * 13 / 14 + n.tr / 14 END,
        CASE WHEN n.pos = 13 THEN n.sp ELSE z.p * 13 / 14 + n.pdm / 14 END, CASE WHEN n.pos = 13 THEN n.sm ELSE z.m * 13 / 14 + n.mdm / 14 END
      FROM z JOIN es n ON n.symbol = z.symbol AND n.pos = z.pos + 1),
    dx AS (SELECT symbol, pos, 100 * abs(p / t - m / t) / nullif(p / t + m / t, 0) AS dx FROM z),
    ds AS (SELECT symbol, avg(dx) AS s FROM dx WHERE pos BETWEEN 13 AND 26 GROUP BY 1 HAVING count(dx) = 14),
    ax AS (SELECT symbol, CAST(26 AS BIGINT) AS pos, s AS a FROM ds UNION ALL SELECT d.symbol, d.pos, ax.a * 13 / 14 + d.dx / 14 FROM ax JOIN dx d ON d.symbol = ax.symbol AND d.pos = ax.pos + 1),
    b1 AS (SELECT nb.*, e12, e26, ag, al, CASE WHEN nb.pos >= 13 THEN atr END AS atr, a AS adx, close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 3) OVER w - 1 AS ret_3, close / lag(close, 12) OVER w - 1 AS ret_12,
        close / lag(close, 36) OVER w - 1 AS ret_36, close / lag(close, 72) OVER w - 1 AS ret_72, volume / nullif(lag(volume) OVER w, 0) - 1 AS vol_change
      FROM nb JOIN z USING (symbol, pos) LEFT JOIN ax USING (symbol, pos) WINDOW w AS (PARTITION BY nb.symbol ORDER BY nb.pos)),
    b2 AS (SELECT *, {_whole('avg(close)', 'close', 50)} AS s50, {_whole('avg(close)', 'close', 200)} AS s200, {_whole('stddev_samp(close)', 'close', 24)} AS sd24, {_whole('stddev_samp(ret_1)', 'ret_1', 12)} AS rv,
        {_whole('avg(volume)', 'volume', 24)} AS v24, {_whole('avg(volume)', 'volume', 168)} AS v168 FROM b1 WINDOW {_trail(12, 24, 50, 168, 200)}),
    b3 AS (SELECT *, lag(s50, 12) OVER (PARTITION BY symbol ORDER BY pos) AS s50_12, array_agg(sd24) OVER f288 AS hs, count(sd24) OVER f288 AS ns, array_agg(atr) OVER f288 AS ha, count(atr) OVER f288 AS na FROM b2 WINDOW {_trail(288)})
    SELECT symbol, epoch_ms(ts) AS ts_ms, """ + ", ".join(
    f"round({x}, 6) + 0.0 AS {n}"
    for n, x in {
        **{f"ret_{k}": f"ret_{k}" for k in (1, 3, 12, 36, 72)},
        "sma50_ratio": "close / s50 - 1", "sma200_ratio": "close / s200 - 1", "ema12_ratio": "close / e12 - 1", "ema26_ratio": "close / e26 - 1",
        "sma_trend": "CASE WHEN s50 > s200 THEN 1.0 WHEN s50 <= s200 THEN 0.0 END", "sma50_slope": "s50 / s50_12 - 1",
        "vol_z": "volume / v24 - 1", "vol_change": "vol_change", "vol_ratio_168": "volume / v168 - 1",
        "rsi14": "CASE WHEN pos >= 14 THEN CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END END", "roc_36": "ret_36",
        "ema_diff_12_26": "(e12 - e26) / close", "atr14_ratio": "atr / close", "roll_std_24_ratio": "sd24 / close", "rv_12": "rv * sqrt(288 * 365.0)",
        "vol_percentile_1d": "CASE WHEN ns = 288 THEN len(list_filter(hs, lambda q: q <= sd24)) / 288.0 END",
        "body_ratio": "abs(close - open) / nullif(high - low, 0)", "up_wick_ratio": "(high - greatest(open, close)) / nullif(high - low, 0)",
        "low_wick_ratio": "(least(open, close) - low) / nullif(high - low, 0)", "close_pos": "(close - low) / nullif(high - low, 0)", "range_pct": "nullif(high - low, 0) / close",
        "adx14_ratio": "adx / 100", "vol_rank_288": "CASE WHEN na = 288 THEN len(list_filter(ha, lambda q: q <= atr)) / 288.0 END",
    }.items()
) + " FROM b3"


@query("bar_features_28", "K1 B1 B2 E5 E26 E27", FEATURES_SQL)
def _(v):
    return bar_features(v.bars, BAR_SERIES).select("symbol", ms("ts").alias("ts_ms"), *[r(c).alias(c) for c in BLOCK_COLUMNS["B3"]])


@query(
    "market_scan_latest",
    "K22 B15 B16 F6 E40",
    f"""WITH RECURSIVE {DIFF}, s AS (SELECT symbol, avg(g) AS ag, avg(l) AS al FROM e WHERE pos BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14),
      x AS (SELECT symbol, CAST(14 AS BIGINT) AS pos, ag, al FROM s
      UNION ALL SELECT n.symbol, n.pos, x.ag * 13 / 14 + n.g / 14, x.al * 13 / 14 + n.l / 14 FROM x JOIN e n ON n.symbol = x.symbol AND n.pos = x.pos + 1),
      m AS (SELECT symbol, ts, pos, close, avg(close) OVER r50 AS f50, count(close) OVER r50 AS n50, avg(close) OVER r200 AS f200, count(close) OVER r200 AS n200,
          close / lag(close, 1) OVER w - 1 AS c1, close / lag(close, 12) OVER w - 1 AS c12 FROM nb
        WINDOW w AS (PARTITION BY symbol ORDER BY ts), r50 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
          r200 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
      last AS (SELECT symbol, max(pos) AS pos FROM nb GROUP BY 1)
      SELECT m.symbol, epoch_ms(m.ts) AS ts_ms, m.close, round(100 - 100 / (1 + ag / al), 6) + 0.0 AS rsi, round(c1, 6) + 0.0 AS change_1,
        round(c12, 6) + 0.0 AS change_12, CASE WHEN 100 - 100 / (1 + ag / al) < 30 AND n50 = 50 AND n200 = 200 AND f50 > f200 THEN 'BUY'
        WHEN 100 - 100 / (1 + ag / al) > 70 THEN 'SELL' ELSE 'WAIT' END AS signal
      FROM m JOIN last USING (symbol, pos) LEFT JOIN x USING (symbol, pos)""",
)
def _(v):
    from tidegauge.operators.market import scan

    out = scan(v.bars, BAR_SERIES)
    return rounded(
        out.select("symbol", ms("ts").alias("ts_ms"), "close", "rsi", "change_1", "change_12", "signal"),
        "rsi", "change_1", "change_12",
    )


@query(
    "market_signal_counts",
    "D36",
    f"""WITH RECURSIVE {DIFF}, s AS (SELECT symbol, avg(g) AS ag, avg(l) AS al FROM e WHERE pos BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14),
      x AS (SELECT symbol, CAST(14 AS BIGINT) AS pos, ag, al FROM s
      UNION ALL SELECT n.symbol, n.pos, x.ag * 13 / 14 + n.g / 14, x.al * 13 / 14 + n.l / 14 FROM x JOIN e n ON n.symbol = x.symbol AND n.pos = x.pos + 1),
      last AS (SELECT symbol, max(pos) AS pos FROM nb GROUP BY 1), r AS (SELECT symbol, 100 - 100 / (1 + ag / al) AS rsi FROM x JOIN last USING (symbol, pos))
      SELECT count(*) AS symbols, count(*) FILTER (rsi > 52) AS above, count(*) FILTER (rsi < 48) AS below, count(*) FILTER (rsi BETWEEN 48 AND 52) AS between_both FROM r""",
)
def _(v):
    from tidegauge.operators.market import scan

    rsi = F.col("rsi")
    return scan(v.bars, BAR_SERIES).agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(rsi > 52).alias("above"), F.count_if(rsi < 48).alias("below"),
        F.count_if(rsi.between(48, 52)).alias("between_both"),
    )
