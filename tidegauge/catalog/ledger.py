"""Trade-ledger analytics: D7-D14, D17, D18, D23, D29-D31, I1-I4, F1-F7, B14, B20, B21."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import TRADES, ms, query, r, rounded
from tidegauge.functions.scalar import bands
from tidegauge.operators import bars
from tidegauge.operators import ledger as L
from tidegauge.plans.ranking import exact_quantiles

SPINE = f"""{TRADES}, d AS (SELECT pair, CAST(close_date AS DATE) AS day, sum(profit_abs) AS pa, sum(profit_ratio) AS pr FROM trades GROUP BY 1, 2),
    ends AS (SELECT pair, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
    grid AS (SELECT pair, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
    days AS (SELECT pair, day, coalesce(pa, 0) AS pa, coalesce(pr, 0) AS pr FROM grid LEFT JOIN d USING (pair, day))"""

START = 1e7


@query(
    "trade_summary",
    "D7 I3",
    f"""WITH {TRADES} SELECT pair, count(*) AS n, round(sum(profit_abs), 4) + 0.0 AS net, round(sum(profit_abs) FILTER (profit_abs > 0), 4) + 0.0 AS gross_win,
      round(-sum(profit_abs) FILTER (profit_abs < 0), 4) + 0.0 AS gross_loss, round(avg(profit_ratio), 7) + 0.0 AS mean_ratio,
      round(avg(CASE WHEN profit_abs > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS win_rate,
      round(sum(profit_abs) FILTER (profit_abs > 0) / -sum(profit_abs) FILTER (profit_abs < 0), 6) + 0.0 AS profit_factor,
      max(profit_abs) AS largest_win, min(profit_abs) AS largest_loss, round(sum(stake_amount) * 0.002, 6) + 0.0 AS fee, round(sum(stake_amount) * 0.001, 6) + 0.0 AS slippage,
      count(*) FILTER (status = 'O') AS forced, round(avg(profit_ratio), 7) + 0.0 AS avg_ret,
      round(quantile_cont(date_diff('second', open_date, close_date) / 60.0, 0.5), 4) + 0.0 AS median_hold FROM trades GROUP BY 1""",
)
def _(v):
    out = L.trade_costs(v.trades, ["pair"], F.col("stake_amount") * 0.002, F.col("stake_amount") * 0.001, F.col("status") == "O")
    return out.withColumns(
        {
            **{c: r(c, 6) for c in ("fee", "slippage")},
            "median_hold": r("median_hold", 4),
            "avg_ret": r("avg_ret", 7),
            **{c: r(c, 4) for c in ("net", "gross_win", "gross_loss")},
            "mean_ratio": r("mean_ratio", 7),
            "win_rate": r("win_rate"),
            "profit_factor": r("profit_factor"),
        }
    )


@query(
    "daily_sharpe_sortino",
    "I1 D1",
    f"""WITH {SPINE} SELECT pair, round(avg(pr) / stddev_samp(pr) * sqrt(365), 6) + 0.0 AS sharpe,
      round(avg(pr) / (stddev_samp(pr) FILTER (pr < 0)) * sqrt(365), 6) + 0.0 AS sortino FROM days GROUP BY 1""",
)
def _(v):
    d = L.day_sums(v.trades, v.trades_on, ["pair"], "profit_ratio", ["file", "row"])
    d = bars.daily_zero_filled(d, "day", ["profit_ratio"], ("pair",))
    return rounded(d.groupBy("pair").agg(*L.returns_stats("profit_ratio", 365)), "sharpe", "sortino")


@query(
    "strict_sharpe_sortino_by_year",
    "I2 D29",
    f"""WITH {TRADES}, d AS (SELECT pair, CAST(close_date AS DATE) AS day, sum(profit_ratio) AS pr FROM trades GROUP BY 1, 2)
      SELECT pair, year(day) AS year, CASE WHEN count(*) >= 3 THEN round(CASE WHEN stddev_samp(pr) = 0 THEN 0 ELSE avg(pr) / stddev_samp(pr) * sqrt(365) END, 6) + 0.0 END AS sharpe,
       CASE WHEN count(*) >= 3 AND count(*) FILTER (pr < 0) >= 2 AND stddev_samp(pr) > 0 AND (stddev_samp(pr) FILTER (pr < 0)) > 0
         THEN round(avg(pr) / (stddev_samp(pr) FILTER (pr < 0)) * sqrt(365), 6) + 0.0 END AS sortino FROM d GROUP BY 1, 2""",
)
def _(v):
    d = L.day_sums(v.trades, v.trades_on, ["pair"], "profit_ratio", ["file", "row"])
    out = d.groupBy("pair", F.year("day").cast("long").alias("year")).agg(*L.returns_stats("profit_ratio", 365, strict=True))
    return rounded(out, "sharpe", "sortino")


@query(
    "window_metrics_wallet",
    "D8 E18 B3 C16",
    f"""WITH {SPINE}, e AS (SELECT pair, day, {START} + sum(pa) OVER w AS eq FROM days WINDOW w AS (PARTITION BY pair ORDER BY day)),
      k AS (SELECT pair, eq / greatest(max(eq) OVER w, {START}) - 1 AS dd FROM e WINDOW w AS (PARTITION BY pair ORDER BY day)),
      m AS (SELECT pair, min(dd) AS max_dd FROM k GROUP BY 1),
      s AS (SELECT pair, count(*) AS n_days, avg(pr) / stddev_samp(pr) * sqrt(365) AS sharpe FROM days GROUP BY 1),
      t AS (SELECT pair, count(*) AS n, sum(profit_abs) AS net, sum(stake_amount) AS volume, sum((stake_amount * 2 + profit_abs) * 0.001) AS fees FROM trades GROUP BY 1)
      SELECT pair, n, n_days, round(net, 4) + 0.0 AS net, round(volume, 1) + 0.0 AS volume, round(fees, 3) + 0.0 AS fees, round(sharpe, 6) + 0.0 AS sharpe, round(max_dd, 6) + 0.0 AS max_dd
      FROM t JOIN s USING (pair) JOIN m USING (pair)""",
)
def _(v):
    out = L.window_metrics(v.trades, ["pair"], START)
    return out.select(
        "pair", "n", "n_days", r("net", 4).alias("net"), r("volume", 1).alias("volume"), r("fees", 3).alias("fees"),
        r("sharpe").alias("sharpe"), r("max_dd").alias("max_dd"),
    )


@query(
    "ratio_curve_drawdown",
    "E18 E20",
    f"""WITH {SPINE}, y AS (SELECT pair, day, pr * 0.001 AS pr FROM days), e AS (SELECT pair, day, exp(sum(ln(1 + pr)) OVER w) AS eq FROM y WINDOW w AS (PARTITION BY pair ORDER BY day)),
      k AS (SELECT pair, eq / max(eq) OVER w - 1 AS dd FROM e WINDOW w AS (PARTITION BY pair ORDER BY day))
      SELECT pair, round(min(dd), 6) + 0.0 AS max_dd_ratio FROM k GROUP BY 1""",
)
def _(v):
    d = L.daily(v.trades, ["pair"]).withColumn("profit_ratio", F.col("profit_ratio") * 0.001)
    return rounded(L.ratio_drawdown(d, ["pair"]), "max_dd_ratio")


@query(
    "trades_per_year_sharpe",
    "I4",
    f"""WITH {TRADES}, t AS (SELECT pair, count(*) / (greatest(1, date_diff('day', min(close_date), max(close_date)) + 1) / 365.0) AS tpy,
        avg(profit_ratio) AS m, stddev_samp(profit_ratio) AS s FROM trades GROUP BY 1)
      SELECT pair, round(tpy, 6) + 0.0 AS trades_per_year, round(m / s * sqrt(floor(tpy)), 6) + 0.0 AS sharpe FROM t""",
)
def _(v):
    days = F.greatest(F.lit(1), F.datediff(F.max("close_date"), F.min("close_date")) + 1)
    t = v.trades.groupBy("pair").agg(
        (F.count(F.lit(1)) / (days / 365.0)).alias("tpy"), F.avg("profit_ratio").alias("m"), F.stddev_samp("profit_ratio").alias("s")
    )
    return t.select("pair", r("tpy").alias("trades_per_year"), r(F.col("m") / F.col("s") * F.sqrt(F.floor("tpy"))).alias("sharpe"))


@query(
    "regime_breakdown_rollup",
    "D9 C12",
    f"""WITH {TRADES} SELECT pair, coalesce(status, 'all') AS bucket, count(*) AS n, round(sum(profit_abs), 4) + 0.0 AS net,
      round(avg(CASE WHEN profit_abs > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS win_rate FROM trades GROUP BY GROUPING SETS ((pair, status), (pair))""",
)
def _(v):
    # one pass per pair and status, the pair totals come from those few rows
    base = v.trades.rollup("pair", "status").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("profit_abs"), 4).alias("net"), r(L.win_rate("profit_abs")).alias("win_rate")
    )
    return base.filter(F.col("pair").isNotNull()).select("pair", F.coalesce("status", F.lit("all")).alias("bucket"), "n", "net", "win_rate")


@query(
    "scalar_totals",
    "D11 D12",
    f"""WITH {TRADES} SELECT round(coalesce(sum(profit_abs), 0), 4) + 0.0 AS realised, count(*) AS n, count(DISTINCT pair) AS pairs,
      count(DISTINCT CAST(close_date AS DATE)) AS days FROM trades WHERE status = 'F'""",
)
def _(v):
    return v.trades.filter("status = 'F'").agg(
        r(F.coalesce(F.sum("profit_abs"), F.lit(0.0)), 4).alias("realised"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("pair").alias("pairs"), F.count_distinct(F.to_date("close_date")).alias("days"),
    )


@query(
    "exact_quantiles_by_pair",
    "D14",
    f"""WITH {TRADES} SELECT pair, round(quantile_cont(profit_abs, 0.05), 5) + 0.0 AS p05, round(quantile_cont(profit_abs, 0.5), 5) + 0.0 AS median,
      round(quantile_cont(profit_abs, 0.95), 5) + 0.0 AS p95 FROM trades GROUP BY 1""",
)
def _(v):
    out = exact_quantiles(v.trades, ["pair"], "profit_abs", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return rounded(out, "p05", "median", "p95", digits=5)


@query(
    "hold_time_buckets",
    "D18 B20",
    f"""WITH {TRADES}, h AS (SELECT *, date_diff('day', open_date, close_date) AS days FROM trades),
      b AS (SELECT *, CASE WHEN days > -1 AND days <= 30 THEN 'month' WHEN days > 30 AND days <= 365 THEN 'year' WHEN days > 365 AND days <= 1500 THEN 'long' WHEN days > 1500 THEN 'older' END AS bucket FROM h)
      SELECT bucket, count(*) AS n, round(sum(profit_abs), 4) + 0.0 AS net, round(avg(CASE WHEN profit_abs > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS win_rate,
        round(corr(days, profit_ratio), 6) + 0.0 AS corr_hold_ret FROM b GROUP BY 1""",
)
def _(v):
    d = F.datediff("close_date", "open_date")
    b = bands(d, [-1, 30, 365, 1500, 10**9], ["month", "year", "long", "older"])
    return v.trades.withColumns({"bucket": b, "days": d}).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("profit_abs"), 4).alias("net"), r(L.win_rate("profit_abs")).alias("win_rate"),
        r(F.corr("days", "profit_ratio")).alias("corr_hold_ret"),
    )


@query(
    "equal_width_histogram",
    "B21 D13",
    f"""WITH {TRADES}, e AS (SELECT pair, min(profit_abs) AS lo, max(profit_abs) AS hi FROM trades GROUP BY 1)
      SELECT pair, CAST(least(19, floor((profit_abs - lo) / (hi - lo) * 20)) AS BIGINT) AS bin, count(*) AS n FROM trades JOIN e USING (pair) GROUP BY 1, 2""",
)
def _(v):
    from tidegauge.operators.quality import equal_width

    return equal_width(v.trades, ["pair"], "profit_abs", 20).groupBy("pair", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "profit_concentration",
    "D23 F4",
    f"""WITH {TRADES}, k AS (SELECT pair, profit_abs, row_number() OVER (PARTITION BY pair ORDER BY profit_abs DESC) AS k FROM trades),
      s AS (SELECT pair, sum(profit_abs) AS net, sum(profit_abs) FILTER (k <= 1) AS t1, sum(profit_abs) FILTER (k <= 3) AS t3, sum(profit_abs) FILTER (k <= 5) AS t5 FROM k GROUP BY 1)
      SELECT pair, round(net, 4) + 0.0 AS net, round(t1 / net, 6) + 0.0 AS share_top1, round(t3 / net, 6) + 0.0 AS share_top3, round(t5 / net, 6) + 0.0 AS share_top5,
        round(net - t5, 4) + 0.0 AS net_ex_top5 FROM s""",
)
def _(v):
    tie = F.struct("order_id", "line", "part_id", "supp_id")
    out = L.concentration(v.trades, ["pair"], "profit_abs", tie)
    return out.select(
        "pair", r("net", 4).alias("net"), *[r(f"share_top{k}").alias(f"share_top{k}") for k in (1, 3, 5)], r("net_ex_top5", 4).alias("net_ex_top5")
    )


@query(
    "trade_list_newest_first",
    "B14 F1 F6",
    f"""WITH {TRADES} SELECT order_id, line, part_id, supp_id, date_diff('second', open_date, close_date) / 60.0 AS minutes, round(stake_amount * 0.002, 6) + 0.0 AS fee, profit_abs
      FROM trades WHERE status = 'F' AND pair = 'R' ORDER BY close_date DESC, order_id, line, part_id, supp_id LIMIT 50""",
)
def _(v):
    from tidegauge.functions.scalar import minutes_between

    t = v.trades.filter((F.col("status") == "F") & (F.col("pair") == "R"))
    t = t.orderBy(F.col("close_date").desc(), "order_id", "line", "part_id", "supp_id").limit(50)
    return t.select(
        "order_id", "line", "part_id", "supp_id", minutes_between(F.col("open_date"), F.col("close_date")).alias("minutes"),
        r(F.col("stake_amount") * 0.002).alias("fee"), "profit_abs",
    )


@query(
    "best_group_by_metric",
    "F5 F7",
    f"""WITH {TRADES}, g AS (SELECT line, pair, avg(profit_ratio) AS m FROM trades GROUP BY 1, 2)
      SELECT line, arg_min(pair, (-round(m, 9), pair)) AS best_pair, round(max(m), 7) + 0.0 AS best FROM g GROUP BY 1""",
)
def _(v):
    g = v.trades.groupBy("line", "pair").agg(F.avg("profit_ratio").alias("m"))
    return g.groupBy("line").agg(F.min_by("pair", F.struct(-F.round("m", 9), "pair")).alias("best_pair"), r(F.max("m"), 7).alias("best"))


@query(
    "two_source_mean_gap",
    "D30",
    f"""WITH {TRADES} SELECT count(*) FILTER (status = 'O') AS n_paper, count(*) FILTER (status = 'F') AS n_backtest,
      round(avg(profit_ratio) FILTER (status = 'O') - avg(profit_ratio) FILTER (status = 'F'), 7) + 0.0 AS gap FROM trades""",
)
def _(v):
    p, b = F.when(F.col("status") == "O", F.col("profit_ratio")), F.when(F.col("status") == "F", F.col("profit_ratio"))
    return v.trades.agg(F.count(p).alias("n_paper"), F.count(b).alias("n_backtest"), r(F.avg(p) - F.avg(b), 7).alias("gap"))


@query(
    "seed_stability_ranking",
    "D31",
    f"""WITH {TRADES}, s AS (SELECT pair, line, avg(profit_ratio) AS m FROM trades GROUP BY 1, 2),
      a AS (SELECT pair, avg(m) AS mean_m, quantile_cont(m, 0.5) AS med_m, stddev_samp(m) AS sd_m, count(*) AS n FROM s GROUP BY 1)
      SELECT pair, n, round(mean_m, 7) + 0.0 AS mean_m, round(med_m, 7) + 0.0 AS med_m, round(sd_m, 7) + 0.0 AS sd_m,
        row_number() OVER (ORDER BY med_m DESC, sd_m, pair) AS place FROM a""",
)
def _(v):
    from pyspark.sql import Window

    s = v.trades.groupBy("pair", "line").agg(F.avg("profit_ratio").alias("m"))
    a = s.groupBy("pair").agg(
        F.avg("m").alias("mean_m"), F.percentile("m", F.lit(0.5)).alias("med_m"), F.stddev_samp("m").alias("sd_m"), F.count(F.lit(1)).alias("n")
    )
    place = F.row_number().over(Window.orderBy(F.col("med_m").desc(), "sd_m", "pair")).cast("long")
    return rounded(a.withColumn("place", place), "mean_m", "med_m", "sd_m", digits=7)


@query(
    "label_economics",
    "D16 D26",
    f"""WITH {TRADES} SELECT pair, round(avg(CASE WHEN profit_ratio > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS p_pos, round(avg(CASE WHEN profit_ratio > 0.02 THEN 1.0 ELSE 0 END), 6) + 0.0 AS p_over,
      round(avg(profit_ratio) FILTER (profit_ratio > 0), 6) + 0.0 AS mean_if_pos, round(avg(CASE WHEN profit_ratio < -0.02 THEN 1.0 ELSE 0 END), 6) + 0.0 AS p_under,
      round(avg(profit_ratio), 7) + 0.0 AS mean, round(quantile_cont(profit_ratio, 0.5), 6) + 0.0 AS median FROM trades GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.scoring import tail_profile

    out = tail_profile(v.trades, ["pair"], "profit_ratio", 0.02)
    return rounded(out.withColumn("mean", r("mean", 7)), "p_pos", "p_over", "mean_if_pos", "p_under", "median")


@query(
    "global_concentration_top_k",
    "F4",
    f"""WITH {TRADES} SELECT profit_abs FROM trades ORDER BY profit_abs DESC LIMIT 10""",
)
def _(v):
    return v.trades.select("profit_abs").orderBy(F.col("profit_abs").desc()).limit(10)


@query(
    "performance_report",
    "D10 D1 E18",
    f"""WITH {SPINE}, e AS (SELECT pair, day, {START} + sum(pa) OVER w AS eq FROM days WINDOW w AS (PARTITION BY pair ORDER BY day)),
      k AS (SELECT pair, eq, eq / greatest(max(eq) OVER (PARTITION BY pair ORDER BY day), {START}) - 1 AS dd, day FROM e),
      m AS (SELECT pair, min(dd) AS max_dd, arg_max(eq, day) AS last_equity FROM k GROUP BY 1)
      SELECT pair, count(*) FILTER (profit_abs > 0) AS wins, count(*) FILTER (profit_abs <= 0) AS losses, round(avg(profit_abs) FILTER (profit_abs > 0), 5) + 0.0 AS avg_win,
        round(avg(profit_abs) FILTER (profit_abs <= 0), 5) + 0.0 AS avg_loss, round(sum(profit_abs) FILTER (profit_abs > 0) / -sum(profit_abs) FILTER (profit_abs < 0), 6) + 0.0 AS profit_factor,
        max(profit_abs) AS largest_win, min(profit_abs) AS largest_loss, round(avg(profit_abs), 5) + 0.0 AS avg_trade, round(max(max_dd), 6) + 0.0 AS max_dd, round(max(last_equity), 4) + 0.0 AS last_equity FROM trades JOIN m USING (pair) GROUP BY 1""",
)
def _(v):
    parts = L.day_parts(v.trades, ["pair"])
    kpi = L.day_totals(parts, ["pair"]).select(
        "pair", "wins", "losses", r("avg_win", 5).alias("avg_win"), r("avg_loss", 5).alias("avg_loss"), r(F.col("net") + START, 4).alias("last_equity"),
        r("profit_factor").alias("profit_factor"), "largest_win", "largest_loss", r("avg_trade", 5).alias("avg_trade"),
    )
    return kpi.join(rounded(L.wallet_drawdown(L.filled(parts, ["pair"]), ["pair"], START), "max_dd"), "pair")


@query(
    "round_trip_after_costs",
    "H11 D7",
    f"""WITH {TRADES} SELECT pair, status, round(sum(stake_amount * (1 - 0.001) / (1 + 0.0005) * (1 + profit_ratio) * (1 - 0.0005) * (1 - 0.001) - stake_amount), 3) + 0.0 AS net
      FROM trades GROUP BY 1, 2""",
)
def _(v):
    from tidegauge.functions.scalar import round_trip_net

    net = round_trip_net(F.col("stake_amount"), F.lit(1.0), 1 + F.col("profit_ratio"), 0.001, 0.0005)
    return v.trades.groupBy("pair", "status").agg(r(F.sum(net), 3).alias("net"))
