"""Positions and simulated ledgers: E29-E38, D33, D34, D24, K6, K9, K20."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import ACTIONS, BARS, TICKS, ms, query, r, rounded
from tidegauge.operators import positions as P
from tidegauge.sources.views import BAR_SERIES

WSQL = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"

TRACK = f"""{ACTIONS}, t0 AS (SELECT *, coalesce(last_value(CASE WHEN action = 1 THEN 1 WHEN action = 2 THEN 0 END IGNORE NULLS)
        OVER w, 0) AS held FROM acts {WSQL}),
    tr AS (SELECT *, coalesce(lag(held) OVER w, 0) AS held_before FROM t0 {WSQL})"""

# row-by-row trade list: each buy meets the next sell, else the symbol's last bar
LEDGER = f"""{TRACK}, b AS (SELECT symbol, ts, close, row_number() OVER w AS k FROM tr WHERE held = 1 AND held_before = 0 {WSQL}),
    s AS (SELECT symbol, ts, close, row_number() OVER w AS k FROM tr WHERE held = 0 AND held_before = 1 {WSQL}),
    z AS (SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM nb GROUP BY 1),
    l0 AS (SELECT b.symbol, b.k, b.ts AS open_at, b.close AS open_price, coalesce(s.ts, z.ts) AS close_at, coalesce(s.close, z.close) AS close_price,
        s.ts IS NULL AS forced FROM b LEFT JOIN s USING (symbol, k) JOIN z ON z.symbol = b.symbol),
    l1 AS (SELECT *, 100 * exp(coalesce(sum(ln(0.999 * 0.999 * 0.9995 / 1.0005 * close_price / open_price)) OVER
        (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stake FROM l0),
    led AS (SELECT *, stake * 0.999 / (open_price * 1.0005) AS amount FROM l1)"""


def _tracked(v):
    return P.track(v.actions, BAR_SERIES)


@query(
    "position_state_machine",
    "E30",
    f"WITH {TRACK} SELECT symbol, epoch_ms(ts) AS ts_ms, action, held_before, held, held - held_before AS side FROM tr",
)
def _(v):
    return _tracked(v).select("symbol", ms("ts").alias("ts_ms"), "action", "held_before", "held", "side")


@query(
    "trade_ledger_compounding",
    "E31 H11 D17",
    f"""WITH {LEDGER} SELECT symbol, k AS trade, epoch_ms(open_at) AS open_ms, epoch_ms(close_at) AS close_ms, forced, round(stake, 6) + 0.0 AS stake,
      round(amount * (close_price - open_price), 6) + 0.0 AS gross,
      round(stake * 0.001 + amount * close_price * 0.9995 * 0.001, 6) + 0.0 AS fee,
      round(amount * 0.0005 * (open_price + close_price), 6) + 0.0 AS slippage,
      round(amount * close_price * 0.9995 * 0.999 - stake, 6) + 0.0 AS net FROM led""",
)
def _(v):
    out = P.ledger(_tracked(v), BAR_SERIES)
    num = ("stake", "gross", "fee", "slippage", "net")
    return rounded(
        out.select("symbol", "trade", ms("open_at").alias("open_ms"), ms("close_at").alias("close_ms"), "forced", *num), *num
    )


@query(
    "hysteresis_state",
    "E29",
    f"""WITH {BARS}, x AS (SELECT *, (close - 100) / 200 AS p FROM nb)
      SELECT symbol, epoch_ms(ts) AS ts_ms, coalesce(last_value(CASE WHEN p >= 0.45 THEN 1 WHEN p < 0.15 THEN 0 END IGNORE NULLS) OVER w, 0) AS state FROM x {WSQL}""",
)
def _(v):
    d = v.bars.select("symbol", "ts", ((F.col("close") - 100) / 200).alias("p"))
    return P.hysteresis(d, BAR_SERIES, "p", 0.45, 0.15, "state").select("symbol", ms("ts").alias("ts_ms"), "state")


@query(
    "action_breakdown",
    "D33 D34",
    f"""WITH {TRACK}, c AS (SELECT symbol, CASE WHEN action = 0 THEN 'valid_HOLD' WHEN action = 1 AND held_before = 0 THEN 'valid_BUY'
        WHEN action = 2 AND held_before = 1 THEN 'valid_SELL' WHEN action = 2 THEN 'invalid_SELL_while_flat' ELSE 'invalid_BUY_while_long' END AS class FROM tr),
      n AS (SELECT symbol, class, count(*) AS n FROM c GROUP BY 1, 2)
      SELECT symbol, class, n, round(n / sum(n) OVER (PARTITION BY symbol), 6) + 0.0 AS rate,
        CASE WHEN n < 10 THEN 'EXTREME SMALL-N' WHEN n < 20 THEN 'VERY SMALL-N' WHEN n < 50 THEN 'SMALL-N' ELSE 'normal' END AS flag FROM n""",
)
def _(v):
    from pyspark.sql import Window

    cls = P.action_class(F.col("action"), F.col("held_before"))
    n = _tracked(v).groupBy("symbol", cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))
    return n.select("symbol", "class", "n", r(rate).alias("rate"), P.sample_flag(F.col("n")).alias("flag"))


@query(
    "exposure_fraction",
    "D24",
    f"""WITH {TRACK} SELECT symbol, round(avg(held_before), 6) + 0.0 AS exposure, CAST(sum(CASE WHEN held > held_before THEN 1 ELSE 0 END) AS BIGINT) AS buys,
      CAST(sum(CASE WHEN held < held_before THEN 1 ELSE 0 END) AS BIGINT) AS sells FROM tr GROUP BY 1""",
)
def _(v):
    return _tracked(v).groupBy("symbol").agg(
        r(F.avg("held_before")).alias("exposure"),
        F.count_if(F.col("side") == 1).alias("buys"),
        F.count_if(F.col("side") == -1).alias("sells"),
    )


REENTRY = f"""{TRACK}, re AS (SELECT *, held - held_before AS side, lag(held - held_before) OVER w AS side1 FROM tr {WSQL}),
    ra AS (SELECT symbol, ts, close, CASE WHEN side = -1 THEN 2 WHEN side = 1 OR side1 = -1 THEN 1 ELSE 0 END AS action FROM re)"""


@query(
    "reentry_counterfactual",
    "E32",
    f"""WITH {REENTRY}, rt AS (SELECT *, coalesce(last_value(CASE WHEN action = 1 THEN 1 WHEN action = 2 THEN 0 END IGNORE NULLS) OVER w, 0) AS held FROM ra {WSQL})
      SELECT symbol, epoch_ms(ts) AS ts_ms, action AS re_action, held FROM rt""",
)
def _(v):
    re = P.reentry_actions(_tracked(v), BAR_SERIES).select("symbol", "ts", "close", "re_action")
    return P.track(re, BAR_SERIES, "re_action").select("symbol", ms("ts").alias("ts_ms"), "re_action", "held")


@query(
    "drift_timing_friction",
    "K9 E33 D25",
    f"""WITH {LEDGER}, a AS (SELECT symbol, sum(amount * (close_price - open_price)) / 100 AS gross,
        sum(amount * close_price * 0.9995 * 0.999 - stake) / 100 AS net,
        sum(stake * 0.001 + amount * close_price * 0.9995 * 0.001 + amount * 0.0005 * (open_price + close_price)) / 100 AS friction, count(*) AS n FROM led GROUP BY 1),
      m AS (SELECT symbol, avg(held_before) AS e FROM tr GROUP BY 1),
      h AS (SELECT symbol, arg_max(close, ts) / arg_min(close, ts) AS q FROM nb GROUP BY 1)
      SELECT symbol, n AS n_trades, round(e, 6) + 0.0 AS exposure, round(net, 6) + 0.0 AS net, round(gross, 6) + 0.0 AS gross, round(friction, 6) + 0.0 AS friction,
        round(e * (q - 1), 6) + 0.0 AS drift_gross, round(gross - e * (q - 1), 6) + 0.0 AS timing_gross,
        round(net - e * (0.999 * 0.999 * 0.9995 / 1.0005 * q - 1) + friction, 6) + 0.0 AS timing_net
      FROM a JOIN m USING (symbol) JOIN h USING (symbol)""",
)
def _(v):
    from tidegauge.operators.decompose import drift_timing_friction

    out = drift_timing_friction(_tracked(v), BAR_SERIES)
    num = ("exposure", "net", "gross", "friction", "drift_gross", "timing_gross", "timing_net")
    return rounded(out.select("symbol", "n_trades", *num), *num)


@query(
    "first_barrier_exit",
    "E36",
    f"""WITH {BARS}, e AS (SELECT symbol, ts AS entry_at, close AS p FROM bars),
      j AS (SELECT e.*, b.ts, b.close, CASE WHEN b.low <= p * 0.9 THEN p * 0.9 WHEN b.high >= p * 1.5 THEN p * 1.5 WHEN b.close > 200 THEN b.close END AS px,
         CASE WHEN b.low <= p * 0.9 THEN 'stop_loss' WHEN b.high >= p * 1.5 THEN 'roi' WHEN b.close > 200 THEN 'exit_signal' END AS why
        FROM e JOIN bars b ON e.symbol = b.symbol AND b.ts > e.entry_at AND b.ts <= e.entry_at + INTERVAL 1 DAY)
      SELECT symbol, epoch_ms(entry_at) AS entry_ms, epoch_ms(coalesce(min(ts) FILTER (px IS NOT NULL), max(ts))) AS exit_ms,
        round(coalesce(arg_min(px, ts) FILTER (px IS NOT NULL), arg_max(close, ts)), 6) + 0.0 AS exit_price,
        coalesce(arg_min(why, ts) FILTER (px IS NOT NULL), 'force_exit') AS exit_reason FROM j GROUP BY 1, 2""",
)
def _(v):
    ent = v.bars.select("symbol", F.col("ts").alias("entry_at"), F.col("close").alias("entry_price"))
    path = v.bars.withColumn("exit_flag", (F.col("close") > 200).cast("int"))
    out = P.first_barrier(ent, path, ["symbol"], stop=0.10, target=0.50, horizon_s=86_400)
    return out.select("symbol", ms("entry_at").alias("entry_ms"), ms("exit_at").alias("exit_ms"), r("exit_price").alias("exit_price"), "exit_reason")


@query(
    "decision_event_counts",
    "K6 D39",
    f"""WITH {TRACK}, f AS (SELECT *, lead(close, 12) OVER w / close - 1 AS r12 FROM tr {WSQL}),
      k AS (SELECT symbol, CASE WHEN held > held_before THEN 'buy' WHEN held < held_before THEN 'sell' END AS kind,
         CASE WHEN close > 160 THEN 'high' WHEN close < 125 THEN 'low' ELSE 'mid' END AS regime, r12 FROM f)
      SELECT symbol, kind, regime, count(*) AS n, count(r12) AS n_h12, round(avg(r12), 6) + 0.0 AS mean_r12 FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(v):
    from tidegauge.operators import windows as w
    from tidegauge.plans.series import framed

    t = framed(_tracked(v), BAR_SERIES, lambda d, b: d.withColumn("r12", w.forward_return(b, F.col("close"), 12)), ahead=12)
    c = F.col("close")
    t = t.filter("side <> 0").select(
        "symbol", F.when(F.col("side") == 1, "buy").otherwise("sell").alias("kind"),
        F.when(c > 160, "high").when(c < 125, "low").otherwise("mid").alias("regime"), "r12",
    )
    return t.groupBy("symbol", "kind", "regime").agg(
        F.count(F.lit(1)).alias("n"), F.count("r12").alias("n_h12"), r(F.avg("r12")).alias("mean_r12")
    )
