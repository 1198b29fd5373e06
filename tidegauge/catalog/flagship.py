"""The end-to-end slice: ticks, hourly bars, trend signal, ledger, daily ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, query, r, rounded
from tidegauge.operators import bars as B
from tidegauge.operators import ledger as L
from tidegauge.operators import positions as P
from tidegauge.operators import windows as w
from tidegauge.plans.series import framed
from tidegauge.plans.stage import materialise
from tidegauge.session import prepare
from tidegauge.sources.views import BAR_SERIES, Views

FAST, SLOW, START = 6, 24, 100.0


def _ratios(v: Views) -> DataFrame:
    c = F.col("close")

    def build(d, b):
        d = d.withColumns({"fast": w.sma(b, c, FAST), "slow": w.sma(b, c, SLOW)})
        return d.withColumn("action", F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") < F.col("slow"), 2).otherwise(0))

    bars = materialise(v.bars.select("symbol", "ts", "close"), "bars")
    signals = materialise(framed(bars, BAR_SERIES, build, back=SLOW).select("symbol", "ts", "close", "action"), "signals")
    trades = P.ledger(P.track(signals, BAR_SERIES), BAR_SERIES, stake=START)
    closed = trades.select(
        "symbol", F.col("close_at").alias("close_date"), F.col("net").alias("profit_abs"), (F.col("net") / F.col("stake")).alias("profit_ratio")
    )
    closed = materialise(closed, "closed")
    days = materialise(L.daily(closed, ["symbol"]), "days")
    ratios = days.groupBy("symbol").agg(*L.returns_stats("profit_ratio", 365), F.count(F.lit(1)).alias("n_days"))
    totals = L.summary(closed, ["symbol"]).select("symbol", "n", "net", "win_rate")
    return totals.join(ratios, "symbol").join(L.wallet_drawdown(days, ["symbol"], START), "symbol")


def _out(df: DataFrame) -> DataFrame:
    return rounded(df.select("symbol", "n", "n_days", "net", "win_rate", "sharpe", "max_dd"), "net", "win_rate", "sharpe", "max_dd")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_ratios(Views(prepare(spark), sf_dir)))


W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


@query(
    "flagship_trend_ledger_ratios",
    "D2 E4 B15 E30 E31 D1 C16 I1 E18",
    f"""WITH {BARS}, m AS (SELECT symbol, ts, close, CASE WHEN count(close) OVER f = {FAST} THEN avg(close) OVER f END AS fast, CASE WHEN count(close) OVER s = {SLOW} THEN avg(close) OVER s END AS slow
        FROM nb WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {FAST - 1} PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {SLOW - 1} PRECEDING AND CURRENT ROW)),
      h AS (SELECT *, coalesce(last_value(CASE WHEN fast > slow THEN 1 WHEN fast < slow THEN 0 END IGNORE NULLS) OVER w, 0) AS held FROM m {W}),
      t AS (SELECT *, coalesce(lag(held) OVER w, 0) AS hb FROM h {W}),
      b AS (SELECT symbol, ts, close, row_number() OVER w AS k FROM t WHERE held = 1 AND hb = 0 {W}), x AS (SELECT symbol, ts, close, row_number() OVER w AS k FROM t WHERE held = 0 AND hb = 1 {W}),
      z AS (SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM nb GROUP BY 1),
      l AS (SELECT b.symbol, b.k, coalesce(x.ts, z.ts) AS ct, 0.999 * 0.999 * 0.9995 / 1.0005 * coalesce(x.close, z.close) / b.close AS g FROM b LEFT JOIN x USING (symbol, k) JOIN z ON z.symbol = b.symbol),
      led AS (SELECT symbol, ct, g - 1 AS ratio, (g - 1) * {START} * exp(coalesce(sum(ln(g)) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS net FROM l),
      d0 AS (SELECT symbol, CAST(ct AS DATE) AS day, sum(net) AS net, sum(ratio) AS ratio FROM led GROUP BY 1, 2),
      e AS (SELECT symbol, min(day) AS lo, max(day) AS hi FROM d0 GROUP BY 1),
      gr AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
      d AS (SELECT symbol, day, coalesce(net, 0) AS net, coalesce(ratio, 0) AS ratio FROM gr LEFT JOIN d0 USING (symbol, day)),
      eq AS (SELECT symbol, day, {START} + sum(net) OVER (PARTITION BY symbol ORDER BY day) AS eq FROM d),
      dd AS (SELECT symbol, eq / greatest({START}, max(eq) OVER (PARTITION BY symbol ORDER BY day)) - 1 AS dd FROM eq)
      SELECT symbol, n, n_days, round(net, 6) + 0.0 AS net, round(win_rate, 6) + 0.0 AS win_rate, round(sharpe, 6) + 0.0 AS sharpe, round(max_dd, 6) + 0.0 AS max_dd
      FROM (SELECT symbol, count(*) AS n, sum(net) AS net, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM led GROUP BY 1)
      JOIN (SELECT symbol, count(*) AS n_days, avg(ratio) / stddev_samp(ratio) * sqrt(365) AS sharpe FROM d GROUP BY 1) USING (symbol)
      JOIN (SELECT symbol, min(dd) AS max_dd FROM dd GROUP BY 1) USING (symbol)""",
)
def _(v):
    return _out(_ratios(v))
