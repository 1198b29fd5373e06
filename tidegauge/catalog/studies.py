"""Composite research jobs: K7, K8, K10, K11, K16, K18, K19, K21, K26, C20, C23."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SCORES, TRADES, ms, query, r, rounded
from tidegauge.operators import gates, reconcile, study
from tidegauge.sources.views import BAR_SERIES

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


@query(
    "reconcile_stored_metrics",
    "C23 K7 K21",
    f"""WITH {TRADES}, a AS (SELECT pair, count(*) AS n, avg(profit_ratio) AS m FROM trades GROUP BY 1)
      SELECT pair, unnest(['n', 'm']) AS metric, round(unnest([n, m]), 7) + 0.0 AS fresh, unnest([true, pair <> 'R']) AS agrees FROM a""",
)
def _(v):
    fresh = v.trades.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.avg("profit_ratio").alias("m"))
    # the stored copy is the same table summed another way, with one wrong entry
    again = v.trades.groupBy("pair", "line").agg(F.count(F.lit(1)).alias("n"), F.sum("profit_ratio").alias("s"))
    stored = again.groupBy("pair").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m"))
    stored = stored.withColumn("m", F.col("m") + F.when(F.col("pair") == "R", 0.5).otherwise(0.0))
    out = reconcile.reconcile(stored, fresh, ["pair"], ["n", "m"], 1e-9)
    return out.select("pair", "metric", r("fresh", 7).alias("fresh"), "agrees")


@query(
    "causality_prefix_check",
    "K8",
    f"WITH {BARS} SELECT count(*) FILTER (close IS NULL) AS breaks FROM bars",
)
def _(v):
    from tidegauge.operators.features import bar_features
    from tidegauge.plans.stage import materialise

    b = materialise(v.bars, "bars")
    bad = reconcile.causality_breaks(b, "ts", "2024-01-20 00:00:00", lambda d: bar_features(d, BAR_SERIES, rank_window=48))
    return bad.agg(F.count(F.lit(1)).alias("breaks"))


@query(
    "fold_result_matching",
    "C20",
    f"""WITH {TRADES}, f AS (SELECT DISTINCT year(close_date) AS fold FROM trades), g AS (SELECT year(close_date) AS y, pair FROM trades WHERE year(close_date) <> 1997 GROUP BY 1, 2),
      n AS (SELECT y, count(*) FILTER (pair = 'A' OR (pair = 'R' AND y = 1998)) AS k FROM g GROUP BY 1)
      SELECT fold, coalesce(k, 0) AS n_results, CASE WHEN coalesce(k, 0) = 0 THEN 'missing' WHEN k > 1 THEN 'duplicate' ELSE 'matched' END AS state FROM f LEFT JOIN n ON fold = y""",
)
def _(v):
    y = F.year("close_date")
    yr = v.trades.select(y.cast("long").alias("fold")).distinct()
    folds = yr.select("fold", F.make_date(F.col("fold").cast("int"), F.lit(1), F.lit(1)).alias("a"), F.make_date(F.col("fold").cast("int"), F.lit(12), F.lit(31)).alias("b"))
    res = v.trades.filter(y != 1997).groupBy(y.alias("y"), "pair").agg(F.count(F.lit(1)).alias("n"))
    res = res.filter((F.col("pair") == "A") | ((F.col("pair") == "R") & (F.col("y") == 1998)))
    res = res.select(F.make_date("y", F.lit(1), F.lit(1)).alias("a"), F.make_date("y", F.lit(12), F.lit(31)).alias("b"))
    return reconcile.match_folds(res, folds, "a", "b").select("fold", "n_results", "state")


RULES = f"""{BARS}, ev AS (SELECT 'E1' AS rule, 1.0 AS dir, 48 AS h, * FROM bars WHERE dayofweek(ts) = 5 AND hour(ts) = 23
        UNION ALL SELECT 'E2', 1.0, 8, * FROM bars WHERE hour(ts) = 0 UNION ALL SELECT 'E3', -1.0, 3, * FROM bars WHERE hour(ts) % 8 = 0),
      n AS (SELECT e.symbol, e.rule, e.ts, e.dir * (b.close / e.close - 1) - 0.0015 AS net FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.ts = e.ts + to_hours(e.h))"""


def _rules(v):
    from tidegauge.operators.events import net_of_cost, scheduled

    hr = F.hour("ts")
    rules = {
        "E1": ((F.dayofweek("ts") == 6) & (hr == 23), 48 * 3600),
        "E2": (hr == 0, 8 * 3600),
        "E3": (hr % 8 == 0, 3 * 3600),
    }
    return net_of_cost(scheduled(v.bars, rules), F.when(F.col("rule") == "E3", -1.0).otherwise(1.0), 0.0015)


@query(
    "calendar_rule_backtest",
    "K11 H4 C3 I5 I7",
    f"""WITH {RULES} SELECT rule, count(*) AS n, round(avg(net), 6) + 0.0 AS mean_net, round(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(count(*) / 0.1) ELSE 0 END, 6) + 0.0 AS theta,
      round(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / (stddev_samp(net) / sqrt(count(*))) ELSE 0 END, 6) + 0.0 AS t, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS win_rate FROM n GROUP BY 1""",
)
def _(v):
    out = study.calendar_rule_table(_rules(v), ["rule"], 0.1)
    return rounded(out.select("rule", "n", "mean_net", "theta", "t", "win_rate"), "mean_net", "theta", "t", "win_rate")


@query(
    "calendar_rule_gates",
    "K11 K16 I10",
)
def _(v):
    from tidegauge.operators.stats import bh_adjust

    t = bh_adjust(study.calendar_rule_table(_rules(v), ["rule"], 0.1), [], "p", "rule")
    ok = (F.col("mean_net") > 0) & (F.col("q") < 0.05) & (F.abs("d") >= 0.30)
    return rounded(t.select("rule", "n", "mean_net", "d", "p", "q", ok.alias("chain")), "mean_net", "d", "p", "q")


@query(
    "calendar_rule_overlap_split",
    "C10 K11",
    f"""WITH {RULES}, x AS (SELECT a.symbol, a.ts, a.net, EXISTS (SELECT 1 FROM n b WHERE b.rule = 'E1' AND b.symbol = a.symbol AND b.ts <= a.ts AND a.ts < b.ts + INTERVAL 48 HOUR) AS inside FROM n a WHERE rule = 'E2')
      SELECT inside, count(*) AS n, round(avg(net), 6) + 0.0 AS mean_net FROM x GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.joins import inside_intervals
    from tidegauge.plans.series import Series

    e = _rules(v)
    e1 = e.filter("rule = 'E1'").select("symbol", "entry", "exit")
    e2 = e.filter("rule = 'E2'").select("symbol", F.col("entry").alias("ts"), "net")
    out = inside_intervals(e2, e1, Series(("symbol",), "ts", (), 86_400), "entry", "exit", "inside")
    return out.groupBy("inside").agg(F.count(F.lit(1)).alias("n"), r(F.avg("net")).alias("mean_net"))


@query("cell_metric_bundle", "I24 K18")
def _(v):
    out = study.judged(study.cell_bundle(v.scores, ["cell"], 0.003), [], "cell")
    num = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return rounded(out, *num)


@query("matrix_family_verdict", "K16 K18 F5 I10")
def _(v):
    b = study.cell_bundle(v.scores, ["cell"], 0.003).withColumn("family", (F.col("cell") % 2).cast("string"))
    return study.matrix_verdict(b, "family", "cell", F.concat(F.lit("B"), (F.col("cell") % 3).cast("string")), F.concat(F.lit("M"), (F.col("cell") % 2).cast("string")))


@query(
    "arm_gate_columns",
    "K16",
    f"""WITH {SCORES}, c AS (SELECT cell % 2 AS family, cell, avg(fwd) AS m, stddev_samp(fwd) AS s, count(*) AS n, corr(raw, fwd) AS ic FROM scores GROUP BY 1, 2)
      SELECT CAST(family AS BIGINT) AS family, count(*) FILTER (m > 0) AS n_sig, count(*) FILTER (m > 0) >= 1 AS has_sig, count(*) FILTER (m > 0 AND ic >= 0.01) >= 1 AS b_support FROM c GROUP BY 1""",
)
def _(v):
    c = v.scores.groupBy((F.col("cell") % 2).cast("long").alias("family"), "cell").agg(
        F.avg("fwd").alias("m"), F.corr("raw", "fwd").alias("rank_ic")
    )
    cells = c.select(
        "family", F.col("cell").cast("string").alias("cell_id"), F.col("cell").alias("cell_rank"), F.lit("B0").alias("block"), F.lit("M1").alias("model"),
        F.when(F.col("m") > 0, 0.01).otherwise(0.9).alias("q"), F.lit(0.6).alias("auc"), "rank_ic", F.lit(0.5).alias("kendall_tau"),
        F.col("m").alias("pss"), (F.col("m") / 0.003).alias("edge_over_cost"), F.lit(0.4).alias("cohens_d"), F.lit(0.9).alias("power"),
    )
    return gates.arm_gate(cells).select("family", "n_sig", "has_sig", "b_support")


@query(
    "threshold_checks_by_pair",
    "K16 D30",
    f"""WITH {TRADES}, a AS (SELECT pair, avg(profit_ratio) / stddev_samp(profit_ratio) * 10 AS delta, avg(CASE WHEN profit_ratio > 0 THEN 1.0 ELSE 0 END) AS wr, stddev_samp(profit_ratio) * 10 AS sd FROM trades GROUP BY 1)
      SELECT pair, delta >= 0.30 AS sharpe_delta_ok, wr >= 0.60 AS win_rate_ok, abs(sd) <= 0.20 AS max_dd_ok, sd < 0.25 AS seed_std_ok, delta >= 0.30 AND wr >= 0.60 AND abs(sd) <= 0.20 AND sd < 0.25 AS all_pass FROM a""",
)
def _(v):
    a = v.trades.groupBy("pair").agg(
        (F.avg("profit_ratio") / F.stddev_samp("profit_ratio") * 10).alias("delta"),
        F.avg((F.col("profit_ratio") > 0).cast("double")).alias("wr"), (F.stddev_samp("profit_ratio") * 10).alias("sd"),
    )
    return a.select("pair", *[c.alias(n) for n, c in gates.threshold_checks(F.col("delta"), F.col("wr"), F.col("sd"), F.col("sd")).items()])


@query(
    "run_failure_checks",
    "K16 D32",
    f"""WITH {TRADES}, g AS (SELECT order_id % 100 AS run, count(*) AS trades, count(*) FILTER (status = 'O') AS buys, count(*) FILTER (status = 'F') AS sells,
        count(*) FILTER (line = 7) AS invalid, sum(stake_amount) * 0.002 AS fees, sum(greatest(profit_abs, 0)) AS gross FROM trades GROUP BY 1)
      SELECT run, CAST(CASE WHEN invalid / trades > 0.01 THEN 1 ELSE 0 END AS BIGINT) AS n_hard, CAST(CASE WHEN trades > 260.1 THEN 1 ELSE 0 END + CASE WHEN gross > 0 AND fees > gross THEN 1 ELSE 0 END
        + CASE WHEN buys > 0 AND sells = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings, invalid / trades <= 0.01 AS passed FROM g""",
)
def _(v):
    g = v.trades.groupBy((F.col("order_id") % 100).alias("run")).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("status") == "O").alias("buys"), F.count_if(F.col("status") == "F").alias("sells"),
        F.count_if(F.col("line") == 7).alias("invalid"), (F.sum("stake_amount") * 0.002).alias("fees"), F.sum(F.greatest("profit_abs", F.lit(0.0))).alias("gross"),
    )
    g = g.withColumns({"steps": F.col("trades"), "days": F.lit(1.0), "nan_reward": F.lit(False), "bankrupt": F.lit(False), "obs_var": F.lit(1.0)})
    return gates.run_checks(g).select(
        "run", F.size("hard_fails").cast("long").alias("n_hard"), F.size("warnings").cast("long").alias("n_warnings"), "passed"
    )


@query(
    "walk_forward_ledger_report",
    "K19 D9 C12 C19 A8",
    f"""WITH {TRADES}, e AS (SELECT min(close_date) AS lo, max(close_date) AS hi FROM trades),
      f AS (SELECT i AS fold, lo + i * INTERVAL 90 DAY + INTERVAL 455 DAY AS v1, lo + i * INTERVAL 90 DAY + INTERVAL 545 DAY AS t1 FROM e, range(0, 100) t(i) WHERE lo + i * INTERVAL 90 DAY + INTERVAL 545 DAY <= hi),
      reg AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN avg(o_totalprice) > 252000 THEN 'bull' WHEN avg(o_totalprice) < 248000 THEN 'bear' ELSE 'sideways' END AS regime FROM orders GROUP BY 1),
      t AS (SELECT fold, coalesce(regime, 'out_of_window') AS regime, profit_abs, profit_ratio, CAST(close_date AS DATE) AS day FROM trades JOIN f ON close_date >= v1 AND close_date < t1 LEFT JOIN reg ON CAST(close_date AS DATE) = reg.day),
      s AS (SELECT fold, avg(r) / stddev_samp(r) * sqrt(365) AS sharpe FROM (SELECT fold, day, sum(profit_ratio) AS r FROM t GROUP BY 1, 2) GROUP BY 1),
      g AS (SELECT fold, coalesce(regime, 'all') AS regime, count(*) AS n, sum(profit_abs) AS net, avg(CASE WHEN profit_abs > 0 THEN 1.0 ELSE 0 END) AS wr, CASE WHEN sum(greatest(-profit_abs, 0)) > 0 THEN sum(greatest(profit_abs, 0)) / sum(greatest(-profit_abs, 0)) WHEN sum(greatest(profit_abs, 0)) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS pf
        FROM t GROUP BY GROUPING SETS ((fold, regime), (fold)))
      SELECT fold, regime, n, round(net, 4) + 0.0 AS net, round(wr, 6) + 0.0 AS win_rate, round(pf, 6) + 0.0 AS profit_factor, round(sharpe, 6) + 0.0 AS sharpe FROM g JOIN s USING (fold)""",
)
def _(v):
    from tidegauge.plans.folds import rolling_folds

    folds = rolling_folds(v.trades, "close_date", 365, 90, 90, 90)
    mean = F.avg("o_totalprice")
    reg = v.table("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.when(mean > 252000, "bull").when(mean < 248000, "bear").otherwise("sideways").alias("regime")
    )
    out = study.walk_forward_report(v.trades, folds, reg, 1e7)
    out = rounded(out.select("fold", "regime", "n", r("net", 4).alias("net"), "win_rate", "profit_factor", "sharpe"), "win_rate", "profit_factor", "sharpe")
    return out


@query(
    "channel_variant_grid",
    "K26 C22 E45",
    f"""WITH {BARS}, x AS (SELECT nb.*, lead(close) OVER w / close - 1 AS ret, l.n AS length FROM nb, (SELECT unnest([19, 24, 29]) AS n) l WINDOW w AS (PARTITION BY symbol, l.n ORDER BY ts)),
      y AS (SELECT *, CASE length WHEN 19 THEN CASE WHEN count(high) OVER a = 19 THEN max(high) OVER a END WHEN 24 THEN CASE WHEN count(high) OVER b = 24 THEN max(high) OVER b END ELSE CASE WHEN count(high) OVER c = 29 THEN max(high) OVER c END END AS up,
         CASE length WHEN 19 THEN CASE WHEN count(low) OVER a = 19 THEN min(low) OVER a END WHEN 24 THEN CASE WHEN count(low) OVER b = 24 THEN min(low) OVER b END ELSE CASE WHEN count(low) OVER c = 29 THEN min(low) OVER c END END AS dn FROM x
        WINDOW a AS (PARTITION BY symbol, length ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol, length ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY symbol, length ORDER BY ts ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING)),
      z AS (SELECT symbol, length, ts, ret, coalesce(last_value(CASE WHEN close >= up THEN 1 WHEN close <= dn THEN 0 END IGNORE NULLS) OVER w, 0) AS pos FROM y WINDOW w AS (PARTITION BY symbol, length ORDER BY ts)),
      q AS (SELECT *, abs(pos - coalesce(lag(pos) OVER w, 0)) AS turn FROM z WINDOW w AS (PARTITION BY symbol, length ORDER BY ts)),
      m AS (SELECT symbol, length, CAST(cost AS DOUBLE) AS cost, date_trunc('month', ts) AS p, sum(pos * coalesce(ret, 0) - turn * cost) AS net FROM q, (SELECT unnest([0.001, 0.003, 0.005]) AS cost) GROUP BY 1, 2, 3, 4)
      SELECT length, cost, count(*) AS periods, count(*) FILTER (net > 0) AS positive, round(avg(net), 6) + 0.0 AS mean_net FROM m GROUP BY 1, 2""",
)
def _(v):
    return rounded(study.channel_variants(v.bars, BAR_SERIES, (19, 24, 29), (0.001, 0.003, 0.005)), "mean_net")


@query(
    "churn_flips_and_stay",
    "D19 E39",
    f"""WITH {BARS}, s AS (SELECT symbol, ts, CAST(close > 160 AS INTEGER) AS sig FROM nb), x AS (SELECT *, lag(sig) OVER w AS p1, lead(sig) OVER w AS n1, lag(sig, 3) OVER w AS p3 FROM s {W})
      SELECT symbol, count(*) FILTER (sig <> p1) AS flips, count(*) FILTER (sig <> p1 AND sig <> n1) AS isolated, round(avg(CASE WHEN p3 IS NOT NULL THEN CASE WHEN sig = p3 THEN 1.0 ELSE 0 END END), 6) + 0.0 AS stay_3 FROM x GROUP BY 1""",
)
def _(v):
    from tidegauge.plans.series import framed

    def build(d, b):
        g = F.col("sig")
        return d.withColumns({"p1": F.lag(g).over(b.w), "n1": F.lead(g).over(b.w), "p3": F.lag(g, 3).over(b.w)})

    d = framed(v.bars.select("symbol", "ts", (F.col("close") > 160).cast("int").alias("sig")), BAR_SERIES, build, back=3, ahead=1)
    g = F.col("sig")
    return d.groupBy("symbol").agg(
        F.count_if(g != F.col("p1")).alias("flips"), F.count_if((g != F.col("p1")) & (g != F.col("n1"))).alias("isolated"),
        r(F.avg((g == F.col("p3")).cast("double"))).alias("stay_3"),
    )


@query(
    "signal_run_lengths",
    "D19",
    f"""WITH {BARS}, s AS (SELECT symbol, ts, pos, CAST(close > 160 AS INTEGER) AS sig FROM nb), g AS (SELECT *, pos - row_number() OVER (PARTITION BY symbol, sig ORDER BY ts) AS isle FROM s),
      l AS (SELECT symbol, sig, isle, count(*) AS len FROM g GROUP BY 1, 2, 3)
      SELECT symbol, sig, count(*) AS runs, max(len) AS longest, round(avg(len), 6) + 0.0 AS mean_len FROM l GROUP BY 1, 2""",
)
def _(v):
    from tidegauge.operators.windows import run_lengths

    d = v.bars.select("symbol", "ts", (F.col("close") > 160).cast("int").alias("sig"))
    out = run_lengths(d, BAR_SERIES, "sig")
    return out.groupBy("symbol", "sig").agg(F.count(F.lit(1)).alias("runs"), F.max("len").alias("longest"), r(F.avg("len")).alias("mean_len"))
