"""Bars and grids: D2-D6, C14, C16-C18, G2, H2."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SETTLEMENTS, TICKS, TRADES, ms, query, r, rounded
from tidegauge.operators import bars
from tidegauge.plans.series import Series

OHLCV = ("open", "high", "low", "close", "volume")


@query(
    "bars_hourly",
    "D2 H2",
    f"WITH {BARS} SELECT symbol, epoch_ms(ts) AS ts_ms, open, high, low, close, volume FROM bars",
)
def _(v):
    return v.bars.select("symbol", ms("ts").alias("ts_ms"), *OHLCV)


@query(
    "bars_daily_end_label",
    "D4",
    f"""WITH {BARS} SELECT symbol, epoch_ms(date_trunc('day', ts)) + 86400000 AS ts_ms, arg_min(open, ts) AS open,
        max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""",
)
def _(v):
    return bars.resample(v.bars, 86_400, label="end").select("symbol", ms("ts").alias("ts_ms"), *OHLCV)


@query(
    "bars_complete_3h",
    "D3 C14 L2",
    f"""WITH {BARS} SELECT symbol, (epoch_ms(ts) // 10800000) * 10800000 AS ts_ms, arg_min(open, ts) AS open,
        max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
        FROM bars GROUP BY 1, 2 HAVING count(DISTINCT ts) = 3""",
)
def _(v):
    return bars.resample_complete(v.bars, 3600, 10_800).select("symbol", ms("ts").alias("ts_ms"), *OHLCV)


@query(
    "bars_order_flow_seconds",
    "D5",
    f"""WITH {TICKS} SELECT symbol, epoch_ms(date_trunc('second', ts)) AS ts_ms,
        round(sum(CASE WHEN buyer_maker THEN -1.0 ELSE 1.0 END * qty * price), 4) + 0.0 AS signed,
        round(sum(qty * price), 4) + 0.0 AS vol, arg_max(price, (ts, agg_id)) AS px, count(*) AS n FROM ticks GROUP BY 1, 2""",
)
def _(v):
    out = bars.second_bars(v.ticks).select("symbol", ms("ts").alias("ts_ms"), "signed", "vol", "px", "n")
    return rounded(out, "signed", "vol", digits=4)


@query(
    "grid_missing_bars",
    "C18 G2",
    f"""WITH {BARS}, ends AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1),
        grid AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends)
        SELECT symbol, epoch_ms(ts) AS ts_ms FROM grid ANTI JOIN bars USING (symbol, ts)""",
)
def _(v):
    return bars.missing(v.bars, 3600).select("symbol", ms("ts").alias("ts_ms"))


@query(
    "grid_ffill_price_zero_volume",
    "C17",
    f"""WITH {BARS}, ends AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1),
        grid AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends)
        SELECT g.symbol, epoch_ms(g.ts) AS ts_ms,
          last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS close,
          coalesce(b.volume, 0.0) AS volume, b.close IS NULL AS was_filled
        FROM grid g LEFT JOIN bars b USING (symbol, ts)""",
)
def _(v):
    s = Series(("symbol",), "ts", (), span=86_400)
    out = bars.filled(v.bars.select("symbol", "ts", "close", "volume"), 3600, ["close"], ["volume"], s)
    return out.select("symbol", ms("ts").alias("ts_ms"), "close", "volume", "was_filled")


@query(
    "grid_fill_fraction",
    "C17",
    f"""WITH {BARS} SELECT symbol, round(1 - count(*) / ((max(epoch_ms(ts)) - min(epoch_ms(ts))) / 3600000.0 + 1), 6) + 0.0
        AS fill_fraction FROM bars GROUP BY 1""",
)
def _(v):
    full = (F.max(ms("ts")) - F.min(ms("ts"))) / 3_600_000 + 1
    return v.bars.groupBy("symbol").agg(r(1 - F.count(F.lit(1)) / full).alias("fill_fraction"))


@query(
    "daily_pnl_zero_filled",
    "D1 C16",
    f"""WITH {TRADES}, d AS (SELECT pair, CAST(close_date AS DATE) AS day, sum(profit_abs) AS pnl FROM trades GROUP BY 1, 2),
        ends AS (SELECT pair, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
        grid AS (SELECT pair, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM ends)
        SELECT pair, epoch_ms(day) AS day_ms, round(coalesce(pnl, 0), 4) + 0.0 AS pnl FROM grid LEFT JOIN d USING (pair, day)""",
)
def _(v):
    d = v.trades.groupBy("pair", F.to_date("close_date").alias("day")).agg(F.sum("profit_abs").alias("pnl"))
    out = bars.daily_zero_filled(d, "day", ["pnl"], ("pair",))
    return out.select("pair", ms(F.col("day").cast("timestamp")).alias("day_ms"), r("pnl", 4).alias("pnl"))
