"""Capital and carry: E41-E44, E47, K12-K14, K23, D29."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SETTLEMENTS, TRADES, ms, query, r, rounded
from tidegauge.operators import capital as K
from tidegauge.operators import carry
from tidegauge.plans.series import Series

CORE, LOCK = 1_000_000.0, 0.5
S = Series(("pair",), "ts", (), 365 * 86_400)
SLICE = 3 * 365 * 86_400  # seconds of history a task of an ordered fold holds

EQ = f"""{TRADES}, d AS (SELECT pair, date_trunc('day', close_date) AS ts, round(sum(profit_abs), 4) AS pa FROM trades GROUP BY 1, 2),
    q AS (SELECT pair, ts, sum(pa) OVER w AS realised, pa * 0.5 AS unrealised, row_number() OVER w AS i FROM d WINDOW w AS (PARTITION BY pair ORDER BY ts)),
    h AS (SELECT *, {CORE} + realised + unrealised AS equity, greatest({CORE}, max({CORE} + realised + unrealised) OVER (PARTITION BY pair ORDER BY ts)) AS hw FROM q),
    p AS (SELECT *, greatest(0, hw - {CORE}) * {LOCK} AS locked, {CORE} + greatest(0, hw - {CORE}) * {LOCK} AS thr FROM h)"""


def _rows(v):
    from tidegauge.plans.series import running
    from tidegauge.plans.stage import materialise

    d = v.trades.groupBy("pair", F.date_trunc("day", "close_date").alias("ts")).agg(F.round(F.sum("profit_abs"), 4).alias("pa"))
    rows = running(d, S, {"realised": ("sum", "pa")}).withColumn("unrealised", F.col("pa") * 0.5)
    return materialise(rows, "equity")


@query(
    "capital_protection_high_water",
    "E41 E44",
    f"""WITH {EQ} SELECT pair, epoch_ms(ts) AS ts_ms, round(equity, 6) + 0.0 AS equity, round(hw, 6) + 0.0 AS high_water, round(locked, 6) + 0.0 AS locked, round(thr, 6) + 0.0 AS threshold,
      CASE WHEN equity >= thr THEN 'protected' WHEN equity < {CORE} THEN 'at_risk' ELSE 'watch' END AS status FROM p""",
)
def _(v):
    out = K.protection(_rows(v), S, CORE, LOCK)
    return rounded(out.select("pair", ms("ts").alias("ts_ms"), "equity", "high_water", "locked", "threshold", "status"), "equity", "high_water", "locked", "threshold", digits=6)


@query(
    "capital_reserve_recurrence",
    "E42 L7",
    f"""WITH RECURSIVE {EQ}, c AS (SELECT pair, ts, i, greatest(realised, 0) * {LOCK} AS cap, least(locked, greatest(realised, 0) * {LOCK}) AS tgt FROM p),
      z AS (SELECT pair, ts, i, CASE WHEN 0 > cap + 1e-9 THEN tgt ELSE greatest(0, tgt) END AS res FROM c WHERE i = 1
        UNION ALL SELECT c.pair, c.ts, c.i, CASE WHEN z.res > c.cap + 1e-9 THEN c.tgt ELSE greatest(z.res, c.tgt) END FROM z JOIN c ON c.pair = z.pair AND c.i = z.i + 1)
      SELECT pair, epoch_ms(ts) AS ts_ms, round(res, 6) + 0.0 AS reserve FROM z""",
)
def _(v):
    p = K.protection(_rows(v), S, CORE, LOCK)
    out = K.reserve(p, S, K.ReserveStep(LOCK), span=SLICE)
    return out.select("pair", "ts_ms", r("reserve", 6).alias("reserve"))


@query(
    "capital_harvest_view",
    "E43 E44 K23",
    f"""WITH RECURSIVE {EQ}, c AS (SELECT pair, ts, i, realised, equity, greatest(realised, 0) * {LOCK} AS cap, least(locked, greatest(realised, 0) * {LOCK}) AS tgt, epoch_ms(ts) AS t FROM p),
      z AS (SELECT pair, i, t, realised, equity, greatest(0, tgt) + CASE WHEN realised >= 1000 THEN realised * 0.3 ELSE 0 END AS res, CASE WHEN realised >= 1000 THEN realised * 0.3 ELSE 0.0 END AS hv,
          CASE WHEN realised >= 1000 THEN realised * 0.3 ELSE 0.0 END AS tot, CASE WHEN realised >= 1000 THEN t END AS la, CASE WHEN realised >= 1000 THEN realised ELSE 0.0 END AS lr FROM c WHERE i = 1
        UNION ALL SELECT pair, i, t, realised, equity, base + hv, hv, tot + hv, CASE WHEN hv > 0 THEN t ELSE la END, CASE WHEN hv > 0 THEN realised ELSE lr END FROM
          (SELECT c.pair, c.i, c.t, c.realised, c.equity, CASE WHEN z.res > c.cap + 1e-9 THEN c.tgt ELSE greatest(z.res, c.tgt) END AS base,
             CASE WHEN c.realised - z.lr >= 1000 AND (z.la IS NULL OR c.t - z.la >= 604800000) THEN (c.realised - z.lr) * 0.3 ELSE 0.0 END AS hv, z.tot, z.la, z.lr FROM z JOIN c ON c.pair = z.pair AND c.i = z.i + 1))
      SELECT pair, t AS ts_ms, round(res, 6) + 0.0 AS reserve, round(hv, 6) + 0.0 AS harvest, round(tot, 6) + 0.0 AS total_harvested, round({CORE} + greatest(0, realised - tot), 6) + 0.0 AS trading_capital FROM z""",
)
def _(v):
    p = K.protection(_rows(v), S, CORE, LOCK)
    step = K.ReserveStep(LOCK, harvest_ratio=0.3, threshold=1000.0, period="weekly")
    out = K.capital_view(p, K.reserve(p, S, step, span=SLICE), "pair", CORE)
    cols = ("reserve", "harvest", "total_harvested", "trading_capital")
    return rounded(out.select("pair", "ts_ms", *cols), *cols, digits=6)


PANEL = f"""{BARS}, {SETTLEMENTS}, panel AS (SELECT a.symbol, a.ts, a.close AS perp, b.open AS spot FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.ts = a.ts + INTERVAL 1 HOUR)"""


def _panel(v):
    from tidegauge.operators.joins import at_offset

    j = at_offset(v.bars.select("symbol", "ts", F.col("close").alias("perp")), v.bars.select("symbol", "ts", F.col("open").alias("spot")), ["symbol"], 3600, ["spot"])
    return j.filter(F.col("spot").isNotNull())


DAILY = f"""{PANEL}, pd AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_min(perp, ts) AS fp, arg_max(perp, ts) AS lp, arg_max(perp - spot, ts) AS basis FROM panel GROUP BY 1, 2),
    fd AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(rate) AS rate FROM settlements GROUP BY 1, 2),
    dl AS (SELECT symbol, day, coalesce(rate, 0) * fp AS cash, coalesce(basis - lag(basis) OVER w, 0) AS chg, coalesce(rate, 0) * lp + coalesce(basis - lag(basis) OVER w, 0) AS net
      FROM pd LEFT JOIN fd USING (symbol, day) WINDOW w AS (PARTITION BY symbol ORDER BY day))"""


@query(
    "carry_ledger",
    "K12 E19 C8",
    f"""WITH {DAILY}, e AS (SELECT symbol, day, sum(net) OVER w AS eq, net, cash FROM dl WINDOW w AS (PARTITION BY symbol ORDER BY day)),
      k AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY day) - eq AS dd FROM e),
      a AS (SELECT symbol, sum(cash) AS fc, max(dd) AS mdd, stddev_samp(net) AS vol, count(*) AS n_days FROM k GROUP BY 1),
      g AS (SELECT symbol, arg_min(perp, ts) AS p0, arg_max(perp, ts) AS p1, arg_min(spot, ts) AS s0, arg_max(spot, ts) AS s1, count(*) AS n_hours FROM panel GROUP BY 1)
      SELECT symbol, n_hours, n_days, round(fc, 6) + 0.0 AS funding_cash, round((p1 - s1) - (p0 - s0), 6) + 0.0 AS basis_pnl, round(mdd, 6) + 0.0 AS max_dd, round(vol, 6) + 0.0 AS vol_daily,
        round(fc + (p1 - s1) - (p0 - s0) - (s0 + s1) * 0.001 - (p0 + p1) * 0.0005 - (s0 + p0 + s1 + p1) * 0.0005, 6) + 0.0 AS total FROM a JOIN g USING (symbol)""",
)
def _(v):
    out = carry.carry_ledger(_panel(v), v.settlements, "symbol")
    num = ("funding_cash", "basis_pnl", "max_dd", "vol_daily", "total")
    return rounded(out.select("symbol", "n_hours", "n_days", *num), *num)


@query(
    "carry_by_year",
    "D29",
    f"""WITH {DAILY}, e AS (SELECT *, year(day) AS year, sum(net) OVER w AS eq FROM dl WINDOW w AS (PARTITION BY symbol, year(day) ORDER BY day)),
      k AS (SELECT *, max(eq) OVER (PARTITION BY symbol, year ORDER BY day) - eq AS dd FROM e)
      SELECT symbol, year, round(sum(cash), 6) + 0.0 AS funding_cash, round(sum(chg), 6) + 0.0 AS basis_chg, count(*) AS n_days, round(stddev_samp(net), 6) + 0.0 AS net_vol, round(max(dd), 6) + 0.0 AS max_dd FROM k GROUP BY 1, 2""",
)
def _(v):
    out = carry.carry_by_year(carry.daily_carry(_panel(v), v.settlements, "symbol"), "symbol")
    return rounded(out.withColumn("year", F.col("year").cast("long")), "funding_cash", "basis_chg", "net_vol", "max_dd")


@query(
    "margin_path_first_breach",
    "E47",
    f"""WITH {PANEL}, pay AS (SELECT s.symbol, p.ts, s.rate * p.perp AS cash FROM settlements s ASOF JOIN panel p ON s.symbol = p.symbol AND s.ts <= p.ts),
      c AS (SELECT symbol, ts, sum(cash) AS cash FROM pay GROUP BY 1, 2),
      x AS (SELECT symbol, ts, perp, sum(coalesce(cash, 0)) OVER w AS cum, first_value(perp) OVER w AS p0 FROM panel LEFT JOIN c USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      m AS (SELECT *, unnest([0.25, 1.0]) AS margin FROM x), q AS (SELECT *, (margin * p0 + cum + p0 - perp) / perp AS ratio FROM m)
      SELECT symbol, CAST(margin AS DOUBLE) AS margin, round(min(ratio), 6) + 0.0 AS min_ratio, epoch_ms(min(ts) FILTER (ratio <= 0.005)) AS breach_ms FROM q GROUP BY 1, 2""",
)
def _(v):
    s = Series(("symbol",), "ts", (), 86_400)
    out = carry.margin_path(_panel(v), v.settlements, s, [0.25, 1.0])
    return out.select("symbol", "margin", r("min_ratio").alias("min_ratio"), ms("breach_ts").alias("breach_ms"))


@query(
    "quarterly_basis_inverse_contract",
    "K13 H11",
    f"""WITH {PANEL}, l AS (SELECT * FROM panel WHERE ts < TIMESTAMP '2024-01-25'),
      e AS (SELECT symbol, arg_min(perp, ts) AS p0, arg_max(perp, ts) AS pt, arg_min(spot, ts) AS s0, arg_max(spot, ts) AS st, count(*) AS n_bars FROM l GROUP BY 1),
      f AS (SELECT *, p0 * 0.9995 AS pin, 10000 / (p0 * 0.9995) AS w0, 5 / (p0 * 0.9995) AS fi, 10000 * 0.999 / (s0 * 1.0005) AS coins FROM e),
      b AS (SELECT l.symbol, l.ts, l.perp, (w0 - fi + 10000 * (1 / l.perp - 1 / pin)) * l.perp / 10000 AS ratio FROM l JOIN f USING (symbol)),
      h AS (SELECT symbol, min(ratio) AS min_ratio, arg_min(perp, ts) FILTER (ratio <= 0.005) AS hp FROM b GROUP BY 1),
      x AS (SELECT *, coalesce(hp, pt * 1.0005) AS op FROM f JOIN h USING (symbol))
      SELECT symbol, n_bars, round((p0 - s0) / s0, 6) + 0.0 AS entry_basis, round((pt - st) / st, 6) + 0.0 AS exit_basis, hp IS NOT NULL AS breached, round(min_ratio, 6) + 0.0 AS min_ratio,
        round(coins * 0.9995 * 0.999 + w0 - fi + 10000 * (1 / op - 1 / pin) - 5 / op - 10000 / s0 - w0, 6) + 0.0 AS net_coin FROM x""",
)
def _(v):
    p = _panel(v).withColumn("settle", F.lit("2024-01-25").cast("timestamp")).withColumnRenamed("perp", "fut")
    out = carry.basis_contract(p, "symbol", "settle")
    num = ("entry_basis", "exit_basis", "min_ratio", "net_coin")
    return rounded(out.select("symbol", "n_bars", "breached", *num), *num)


@query(
    "event_repricing_with_funding",
    "K14 C9 I5",
    f"""WITH {BARS}, {SETTLEMENTS}, e AS (SELECT symbol, ts, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS ret FROM nb),
      f AS (SELECT e.symbol, e.ts, any_value(ret) AS ret, coalesce(sum(s.rate), 0) AS fund, count(s.rate) AS k FROM e LEFT JOIN settlements s ON s.symbol = e.symbol AND s.ts > e.ts AND s.ts <= e.ts + INTERVAL 4 HOUR WHERE ret IS NOT NULL GROUP BY 1, 2)
      SELECT symbol, count(*) AS n, round(avg(ret), 6) + 0.0 AS gross, round(avg(fund), 8) + 0.0 AS funding_mean, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS cross_rate,
       round(avg(ret - 0.003 - fund), 6) + 0.0 AS net, round(avg(ret) - avg(0.003 + fund), 6) + 0.0 AS margin FROM f GROUP BY 1""",
)
def _(v):
    from tidegauge.operators import windows as w
    from tidegauge.plans.series import framed
    from tidegauge.sources.views import BAR_SERIES

    e = framed(v.bars, BAR_SERIES, lambda d, b: d.withColumn("ret", w.forward_return(b, F.col("close"), 4)), ahead=4)
    e = e.filter("ret IS NOT NULL").select("symbol", "ts", "ret", F.col("ts").alias("event_ts"))
    s = Series(("symbol",), "ts", (), 86_400)
    out = carry.repriced_events(e, v.settlements, s, 4 * 3600, 0.003, ["symbol", "event_ts"])
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("ret")).alias("gross"), r(F.avg("funding"), 8).alias("funding_mean"),
        r(F.avg((F.col("funding_n") > 0).cast("double"))).alias("cross_rate"), r(F.avg("net")).alias("net"), r(F.avg("ret") - F.avg("cost")).alias("margin"),
    )
