"""Row quality and market views: B-items, D6, K24, F2, F8, B13, C13, D36, D38."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SETTLEMENTS, SNAPSHOTS, TICKS, TRADES, ms, query, r, rounded
from tidegauge.operators import quality as Q
from tidegauge.sources.views import BAR_SERIES, TICK_SERIES

WSQL = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


@query(
    "ohlcv_integrity",
    "B22 K24",
    f"""WITH {BARS}, x AS (SELECT symbol, open, high - CASE WHEN hour(ts) = 3 THEN 30 ELSE 0 END AS high, low, close, volume FROM bars)
      SELECT symbol, count(*) AS rows, count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive, count(*) FILTER (volume < 0) AS negative_volume,
       count(*) FILTER (high < greatest(open, close, low)) AS high_broken, count(*) FILTER (low > least(open, close, high)) AS low_broken,
       count(*) FILTER (open IS NULL OR volume IS NULL) AS null_rows FROM x GROUP BY 1""",
)
def _(v):
    x = v.bars.withColumn("high", F.col("high") - F.when(F.hour("ts") == 3, 30).otherwise(0))
    return Q.ohlcv_breaks(x)


@query(
    "continuity_report",
    "B23 B27 K24",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, epoch(ts) - lag(epoch(ts)) OVER w AS d FROM bars {WSQL})
      SELECT symbol, count(*) AS rows, count(*) FILTER (d > 3600) AS gaps, count(*) FILTER (d = 0) AS duplicates,
        CAST((max(epoch(ts)) - min(epoch(ts))) / 3600 + 1 - count(*) AS BIGINT) AS missing, CAST(max(d) AS BIGINT) AS widest_gap_s FROM x GROUP BY 1""",
)
def _(v):
    return Q.continuity(v.bars, BAR_SERIES, 3600)


@query(
    "tick_quality_counters",
    "D6 L5",
    f"""WITH {TICKS}, x AS (SELECT *, lag(ts) OVER w AS pt, lag(agg_id) OVER w AS pid FROM ticks {WSQL})
      SELECT symbol, count(*) AS n_rows, count(*) FILTER (price IS NULL) AS nulls, count(*) FILTER (price <= 0 OR qty <= 0) AS non_positive, count(*) FILTER (ts < pt) AS ts_backward,
        count(*) FILTER (epoch_us(ts) - epoch_us(pt) > 60000000) AS gaps, count(*) FILTER (agg_id <= pid) AS id_backward,
        count(*) FILTER (buyer_maker) AS maker_true, count(*) FILTER (NOT buyer_maker) AS maker_false FROM x GROUP BY 1""",
)
def _(v):
    return Q.tick_counters(v.ticks, TICK_SERIES)


@query(
    "label_bound_filter",
    "B4 B3",
    f"""WITH {BARS} SELECT symbol, count(*) AS n, epoch_ms(max(ts)) AS last_ms FROM bars
      WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' - INTERVAL 12 HOUR GROUP BY 1""",
)
def _(v):
    a, b = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")
    out = v.bars.filter(Q.label_bound(F.col("ts"), a, b, 12, 3600))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max(ms("ts")).alias("last_ms"))


PROTECTED = [("holdout_a", "2024-01-08", "2024-01-09"), ("holdout_b", "2024-01-22", "2024-01-23")]


@query(
    "protected_window_hits",
    "B5 B26",
    f"""WITH {BARS}, p(win, a, b) AS (VALUES ('holdout_a', TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-09'), ('holdout_b', TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-23'))
      SELECT win, count(*) AS n, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms FROM bars JOIN p ON ts BETWEEN a AND b GROUP BY 1""",
)
def _(v):
    w = v.spark.createDataFrame(PROTECTED, "win string, a string, b string").select(
        "win", F.col("a").cast("timestamp").alias("win_start"), F.col("b").cast("timestamp").alias("win_end")
    )
    out = Q.protected_hits(v.bars, "ts", w)
    return out.select("win", "n", ms("first_ts").alias("first_ms"), ms("last_ts").alias("last_ms"))


@query(
    "protected_window_guard_pass",
    "B5 B6",
    f"""WITH {BARS} SELECT CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'train' ELSE 'validation' END AS split, count(*) AS n FROM bars
      WHERE NOT (ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-09') AND NOT (ts BETWEEN TIMESTAMP '2024-01-22' AND TIMESTAMP '2024-01-23') GROUP BY 1""",
)
def _(v):
    t = F.col("ts")
    clean = v.bars
    for _, a, b in PROTECTED:
        clean = clean.filter(~t.between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")))
    clean = Q.guard_protected(clean, "ts", PROTECTED)
    split = F.when(t < F.lit("2024-01-08").cast("timestamp"), "train").otherwise("validation")
    return clean.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedup_keep_first",
    "B11 B12 L4",
    f"""WITH {SNAPSHOTS}, d AS (SELECT symbol, date_trunc('hour', ts) AS h, ts, oi, CAST(ts AS DATE) AS src FROM snapshots),
      k AS (SELECT *, row_number() OVER (PARTITION BY symbol, h ORDER BY src, ts) AS rn FROM d) SELECT symbol, epoch_ms(h) AS hour_ms, oi FROM k WHERE rn = 1""",
)
def _(v):
    from tidegauge.operators.bars import bucket

    d = v.snapshots.select("symbol", bucket("ts", 3600).alias("h"), F.to_date("ts").alias("src"), "ts", "oi")
    return Q.keep_first(d, ["symbol", "h"], ["src", "ts"]).select("symbol", ms("h").alias("hour_ms"), "oi")


@query(
    "time_grid_tolerance",
    "B24",
    f"""WITH {SETTLEMENTS} SELECT symbol, count(*) AS n, count(*) FILTER ((epoch_us(ts) // 1000) % 28800000 <= 600000 OR (epoch_us(ts) // 1000) % 28800000 >= 28200000) AS on_grid FROM settlements GROUP BY 1""",
)
def _(v):
    return v.settlements.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(Q.on_time_grid(ms("ts"), 28_800_000, 600_000)).alias("on_grid")
    )


@query(
    "union_null_rate_gate",
    "B25",
    f"""WITH {BARS}, x AS (SELECT symbol, close / lag(close, 3) OVER w - 1 AS a, CASE WHEN high > low THEN 1 END AS b FROM bars {WSQL})
      SELECT symbol, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 1.0 ELSE 0 END), 6) + 0.0 AS null_rate, avg(CASE WHEN a IS NULL OR b IS NULL THEN 1.0 ELSE 0 END) <= 0.01 AS passed FROM x GROUP BY 1""",
)
def _(v):
    from tidegauge.operators import windows as w
    from tidegauge.plans.series import framed

    d = framed(v.bars, BAR_SERIES, lambda d, b: d.withColumn("a", w.change(b, F.col("close"), 3)), back=3)
    d = d.withColumn("b", F.when(F.col("high") > F.col("low"), 1))
    out = Q.union_null_rate(d, ["a", "b"], ["symbol"])
    return out.select("symbol", r("null_rate").alias("null_rate"), (F.col("null_rate") <= 0.01).alias("passed"))


@query(
    "non_finite_to_null",
    "B8 B9 H5 H6",
    f"""WITH {BARS}, x AS (SELECT symbol, CASE WHEN high > low THEN (close - open) / (high - low) END AS q FROM bars)
      SELECT symbol, count(*) AS n, count(q) AS finite, round(avg(q), 6) + 0.0 AS mean FROM x GROUP BY 1""",
)
def _(v):
    rng = F.col("high") - F.col("low")
    # a zero range is marked NaN or infinite first, as raw files do
    raw = F.when(rng > 0, (F.col("close") - F.col("open")) / rng).when(F.hour("ts") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    d = Q.clean_numeric(v.bars.withColumn("q", raw), ["q"])
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("q").alias("finite"), r(F.avg("q")).alias("mean"))


@query(
    "universe_top_n_pinned",
    "F2 B13",
    f"""WITH {TICKS}, q AS (SELECT user_id, sum(price * qty) AS qv FROM ticks GROUP BY 1), e AS (SELECT *, user_id IN (0, 1) AS pin FROM q WHERE qv >= 1000 OR user_id IN (0, 1)),
      t AS (SELECT * FROM e ORDER BY pin DESC, qv DESC, user_id LIMIT 10)
      SELECT user_id, round(qv, 3) + 0.0 AS qv, row_number() OVER (ORDER BY qv DESC, user_id) AS place FROM t""",
)
def _(v):
    from tidegauge.operators.market import universe

    q = v.ticks.groupBy("user_id").agg(F.round(F.sum(F.col("price") * F.col("qty")), 6).alias("qv"))
    out = universe(q, "qv", "user_id", 1000, 10, [0, 1])
    return out.select("user_id", r("qv", 3).alias("qv"), F.col("place").cast("long").alias("place"))


@query(
    "tradable_symbol_predicate",
    "B13 H9",
    f"""WITH {TICKS} SELECT symbol, count(*) FILTER (event_type IN ('click', 'view') AND qty > 10 AND symbol NOT IN ('S7')) AS tradable FROM ticks GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.market import spot_tradable

    t = v.ticks.withColumns(
        {
            "permissions": F.array(F.array(F.when(F.col("event_type") == "click", "SPOT").otherwise("MARGIN")), F.array(F.when(F.col("event_type") == "view", "SPOT").otherwise("LEVERAGED"))),
            "status": F.when(F.col("qty") > 10, "TRADING").otherwise("BREAK"),
            "quote": F.lit("USDT"),
        }
    )
    ok = spot_tradable(F.col("permissions"), F.col("status"), F.col("quote"), F.col("symbol"), "USDT", ["S7"])
    return t.groupBy("symbol").agg(F.count_if(ok).alias("tradable"))


@query(
    "universe_filters",
    "F8",
    f"""WITH {BARS}, s AS (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, avg((high - low) / close) AS spread, max(high) / min(low) - 1 AS rng FROM bars GROUP BY 1)
      SELECT symbol, date_diff('day', first_ts, TIMESTAMP '2024-01-12') >= 10 AS age_ok, spread <= 0.2 AS spread_ok, rng BETWEEN 0.01 AND 6 AS range_ok FROM s""",
)
def _(v):
    from tidegauge.operators.market import tradable_filters

    s = v.bars.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("spread"), (F.max("high") / F.min("low") - 1).alias("range")
    )
    out = tradable_filters(s, F.lit("2024-01-12").cast("timestamp"), 10, 0.2, 0.01, 6)
    return out.select("symbol", "age_ok", "spread_ok", "range_ok")


@query(
    "open_positions_marked",
    "C13",
    f"""WITH {TICKS}, l AS (SELECT symbol, arg_max(price, ts) AS last_price FROM ticks WHERE symbol <> 'S5' GROUP BY 1),
      p AS (SELECT 'S' || CAST(o_custkey % 8 AS VARCHAR) AS symbol, o_orderkey AS id, o_totalprice / 1000 AS open_rate, 2.0 AS amount FROM orders WHERE o_orderstatus = 'O')
      SELECT symbol, count(*) AS n, round(sum((coalesce(last_price, open_rate) - open_rate) * amount), 4) + 0.0 AS unrealised,
        round(sum(open_rate * amount), 4) + 0.0 AS staked FROM p LEFT JOIN l USING (symbol) GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.market import open_positions

    last = v.ticks.filter("symbol <> 'S5'").groupBy("symbol").agg(F.max_by("price", "ts").alias("last_price"))
    p = v.table("orders").filter("o_orderstatus = 'O'").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 8).cast("string")).alias("symbol"), (F.col("o_totalprice") / 1000).alias("open_rate"), F.lit(2.0).alias("amount")
    )
    out = open_positions(p, last, "symbol")
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("unrealised"), 4).alias("unrealised"), r(F.sum(F.col("open_rate") * F.col("amount")), 4).alias("staked")
    )


@query(
    "portfolio_view",
    "D38 C13 D11",
    f"""WITH {TICKS}, {TRADES}, l AS (SELECT symbol, arg_max(price, ts) AS last_price FROM ticks GROUP BY 1),
      o AS (SELECT 'S' || CAST(order_id % 8 AS VARCHAR) AS symbol, stake_amount, profit_abs, status FROM trades),
      u AS (SELECT count(*) AS n_open, sum((coalesce(last_price, 150) - 150) / 150 * stake_amount) AS unrealised, sum(stake_amount) AS staked FROM o LEFT JOIN l USING (symbol) WHERE status = 'O'),
      c AS (SELECT coalesce(sum(profit_abs), 0) AS realised FROM o WHERE status = 'F')
      SELECT n_open, round(realised, 4) + 0.0 AS realised, round(unrealised, 2) + 0.0 AS unrealised, round((realised + unrealised) / staked, 6) + 0.0 AS return_share FROM u, c""",
)
def _(v):
    from tidegauge.operators.market import portfolio

    last = v.ticks.groupBy("symbol").agg(F.max_by("price", "ts").alias("last_price"))
    t = v.trades.select(
        F.concat(F.lit("S"), (F.col("order_id") % 8).cast("string")).alias("symbol"), F.lit(150.0).alias("open_rate"),
        (F.col("stake_amount") / 150).alias("amount"), "stake_amount", "profit_abs", (F.col("status") == "O").alias("is_open"),
    )
    out = portfolio(t, last, "symbol")
    return out.select("n_open", r("realised", 4).alias("realised"), r("unrealised", 2).alias("unrealised"), r("return_share").alias("return_share"))
