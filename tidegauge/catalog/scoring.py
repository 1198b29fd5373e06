"""Scores against outcomes: D15, D20-D22, D26-D28, D37, F3, I12-I15, I24, I25, B17, B18, K17."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SCORES, TICKS, ms, query, r, rounded
from tidegauge.operators import scoring as S

COST = 0.003

DECILES = f"""{SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score, id) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM scores),
    dec AS (SELECT *, CAST(ceil(10.0 * rn / n) - 1 AS BIGINT) AS bucket FROM rk)"""


@query(
    "decile_table",
    "D20 I24",
    f"""WITH {DECILES} SELECT cell, bucket, count(*) AS size, round(avg(fwd), 7) + 0.0 AS mean, round(quantile_cont(fwd, 0.5), 7) + 0.0 AS median,
      round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS p_gt_0, round(avg(CASE WHEN fwd > {COST} THEN 1.0 ELSE 0 END), 6) + 0.0 AS p_gt_cost,
      round(avg(fwd) - {COST}, 7) + 0.0 AS net, round((avg(fwd) - {COST}) / {COST}, 5) + 0.0 AS edge_over_cost FROM dec GROUP BY 1, 2""",
)
def _(v):
    out = S.decile_table(v.scores, ["cell"], "score", "fwd", "id", COST)
    out = rounded(out, "mean", "median", "net", digits=7)
    return rounded(rounded(out, "p_gt_0", "p_gt_cost"), "edge_over_cost", digits=5)


@query(
    "top_decile_premium",
    "D22 F3 I7 I6",
    f"""WITH {SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM scores),
      m AS (SELECT cell, count(*) FILTER (rn <= ceil(n * 0.1)) AS n_top, avg(fwd) FILTER (rn <= ceil(n * 0.1)) AS mt, stddev_samp(fwd) FILTER (rn <= ceil(n * 0.1)) AS st,
        count(*) FILTER (rn > n - ceil(n * 0.1)) AS n_bot, avg(fwd) FILTER (rn > n - ceil(n * 0.1)) AS mb, stddev_samp(fwd) FILTER (rn > n - ceil(n * 0.1)) AS sb FROM rk GROUP BY 1)
      SELECT cell, n_top, n_bot, round(mt, 7) + 0.0 AS mean_top, round(mb, 7) + 0.0 AS mean_bot, round(mt - {COST}, 7) + 0.0 AS pss, round((mt - {COST}) / {COST}, 5) + 0.0 AS edge_over_cost,
        round((mt - {COST}) / (st / sqrt(n_top)), 6) + 0.0 AS t_stat,
        round((mt - mb) / sqrt(((n_top - 1) * st * st + (n_bot - 1) * sb * sb) / (n_top + n_bot - 2)), 6) + 0.0 AS cohens_d FROM m""",
)
def _(v):
    out = S.top_premium(v.scores, ["cell"], "score", "fwd", "id", COST).drop("sd_top", "sd_bot")
    out = rounded(out, "mean_top", "mean_bot", "pss", digits=7)
    return rounded(rounded(out, "t_stat", "cohens_d"), "edge_over_cost", digits=5)


@query(
    "regime_premium_min_n",
    "D37",
    f"""WITH {SCORES}, g AS (SELECT *, CASE WHEN raw > 35 THEN 'high' WHEN raw < 15 THEN 'low' ELSE 'mid' END AS regime FROM scores),
      rk AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY regime) AS n FROM g)
      SELECT regime, count(*) AS n_top, round(avg(fwd) - {COST}, 7) + 0.0 AS pss FROM rk WHERE rn <= ceil(n * 0.1) GROUP BY 1 HAVING max(n) >= 100""",
)
def _(v):
    raw = F.col("raw")
    g = v.scores.withColumn("regime", F.when(raw > 35, "high").when(raw < 15, "low").otherwise("mid"))
    out = S.top_premium(g, ["regime"], "score", "fwd", "id", COST)
    size = g.groupBy("regime").agg(F.count(F.lit(1)).alias("n")).filter("n >= 100")
    return out.join(size, "regime").select("regime", "n_top", r("pss", 7).alias("pss"))


@query(
    "frozen_quantile_event_filter",
    "B18 D14",
    f"""WITH {SCORES}, q AS (SELECT cell, quantile_cont(score, 0.9) AS cut FROM scores WHERE id % 3 <> 0 GROUP BY 1)
      SELECT cell, count(*) AS n, round(avg(fwd), 7) + 0.0 AS mean FROM scores JOIN q USING (cell) WHERE id % 3 = 0 AND score >= cut GROUP BY 1""",
)
def _(v):
    from tidegauge.plans.ranking import exact_quantiles

    # a train/validation split of the whole table, not a sample: both sides are used in full
    cut = exact_quantiles(v.scores.filter("id % 3 <> 0"), ["cell"], "score", {"cut": 0.9})
    val = v.scores.filter("id % 3 = 0").join(cut, "cell").filter("score >= cut")
    return val.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), r(F.avg("fwd"), 7).alias("mean"))


@query(
    "roc_and_pr_area",
    "I13",
    f"""WITH {SCORES}, t AS (SELECT cell, raw, sum(label) AS p, count(*) AS m FROM scores GROUP BY 1, 2),
      c AS (SELECT *, sum(p) OVER (PARTITION BY cell) AS tp, sum(m) OVER (PARTITION BY cell) AS tm,
        sum(p) OVER (PARTITION BY cell ORDER BY raw DESC) AS cp, sum(m) OVER (PARTITION BY cell ORDER BY raw DESC) AS cm,
        coalesce(sum(m - p) OVER (PARTITION BY cell ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn FROM t)
      SELECT cell, round(sum(p * (bn + (m - p) / 2.0)) / (max(tp) * (max(tm) - max(tp))), 6) + 0.0 AS auc,
        round(sum(p / tp * cp / cm), 6) + 0.0 AS pr_auc FROM c GROUP BY 1""",
)
def _(v):
    return rounded(S.roc_pr_auc(v.scores, ["cell"], "raw", "label"), "auc", "pr_auc")


@query(
    "probability_losses",
    "I14 B17",
    f"""WITH {SCORES}, p AS (SELECT *, score AS p FROM scores)
      SELECT cell, round(avg(-(label * ln(greatest(1e-9, p)) + (1 - label) * ln(1 - p))), 6) + 0.0 AS logloss, round(avg((p - label) * (p - label)), 6) + 0.0 AS brier,
        round(avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = label THEN 1.0 ELSE 0 END), 6) + 0.0 AS accuracy,
        round(sqrt(avg((p - fwd) * (p - fwd))), 6) + 0.0 AS rmse, round(1 - sum((fwd - p) * (fwd - p)) / (var_pop(fwd) * count(*)), 4) + 0.0 AS r2 FROM p GROUP BY 1""",
)
def _(v):
    out = v.scores.withColumn("p", F.col("score")).groupBy("cell").agg(
        *S.probability_losses(F.col("p"), F.col("label")), *S.regression_losses(F.col("p"), F.col("fwd"))
    )
    return rounded(rounded(out, "logloss", "brier", "accuracy", "rmse"), "r2", digits=4)


@query(
    "calibration_error_equal_count",
    "I15",
    f"""WITH {SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score, id) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM scores),
      c AS (SELECT cell, floor((rn - 1) / ceil(n / 10.0)) AS k, count(*) AS m, max(n) AS n, avg(score) AS mp, avg(label) AS my FROM rk GROUP BY 1, 2)
      SELECT cell, round(sum(m / n * abs(mp - my)), 6) + 0.0 AS ece FROM c GROUP BY 1""",
)
def _(v):
    return rounded(S.calibration_error(v.scores, ["cell"], "score", "label", "id"), "ece")


@query(
    "calibration_table",
    "D15 B21",
    f"""WITH {SCORES} SELECT cell, CAST(least(19, floor(score * 20)) AS BIGINT) AS bin, count(*) AS n, round(avg(label), 6) + 0.0 AS label_rate, round(avg(score), 6) + 0.0 AS mean_proba
      FROM scores GROUP BY 1, 2""",
)
def _(v):
    return rounded(S.calibration_table(v.scores, ["cell"], "score", "label"), "label_rate", "mean_proba")


@query(
    "rank_correlation_with_ties",
    "D28 I24",
    f"""WITH {SCORES}, k AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY raw) + (count(*) OVER (PARTITION BY cell, raw) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY cell ORDER BY fwd) + (count(*) OVER (PARTITION BY cell, fwd) - 1) / 2.0 AS rb FROM scores)
      SELECT cell, round(corr(ra, rb), 6) + 0.0 AS rank_ic FROM k GROUP BY 1""",
)
def _(v):
    return rounded(S.rank_correlation(v.scores, ["cell"], "raw", "fwd"), "rank_ic")


@query(
    "kendall_over_deciles",
    "I12",
    f"""WITH {DECILES}, m AS (SELECT cell, bucket, round(avg(fwd), 9) AS v FROM dec GROUP BY 1, 2),
      p AS (SELECT a.cell, sign(b.v - a.v) AS s FROM m a JOIN m b ON a.cell = b.cell AND b.bucket > a.bucket)
      SELECT cell, round(sum(s) / sqrt(count(*) * CAST(count(*) FILTER (s <> 0) AS DOUBLE)), 6) + 0.0 AS kendall_tau FROM p GROUP BY 1""",
)
def _(v):
    t = S.with_decile(v.scores, ["cell"], "score", "id").groupBy("cell", "bucket").agg(
        F.round(F.avg("fwd"), 9).alias("mean")
    )
    return rounded(S.kendall_over_buckets(t, ["cell"], "bucket", "mean"), "kendall_tau")


@query(
    "quantile_edge_buckets",
    "D21",
    f"""WITH {SCORES}, e AS (SELECT cell, list_distinct([quantile_cont(raw, 0), quantile_cont(raw, 0.2), quantile_cont(raw, 0.4), quantile_cont(raw, 0.6), quantile_cont(raw, 0.8), quantile_cont(raw, 1)]) AS es FROM scores GROUP BY 1),
      b AS (SELECT cell, fwd, greatest(0, len(list_filter(es, lambda x: x < raw)) - 1) AS bucket FROM scores JOIN e USING (cell))
      SELECT cell, CAST(bucket AS BIGINT) AS bucket, count(*) AS n, round(avg(fwd), 7) + 0.0 AS mean, round(stddev_samp(fwd), 7) + 0.0 AS sd FROM b GROUP BY 1, 2""",
)
def _(v):
    b = S.quantile_buckets(v.scores, ["cell"], "raw", 5)
    return b.groupBy("cell", "bucket").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("fwd"), 7).alias("mean"), r(F.stddev_samp("fwd"), 7).alias("sd")
    )


@query(
    "difference_corr_beta",
    "D27",
    f"""WITH {BARS}, p AS (SELECT b.symbol, a.ts, a.close AS x, b.close AS y FROM bars a JOIN bars b USING (ts) WHERE a.symbol = 'S0' AND b.symbol <> 'S0'),
      d AS (SELECT symbol, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts))
      SELECT symbol, count(*) AS n, round(corr(dx, dy), 6) + 0.0 AS corr, round(covar_samp(dx, dy) / var_pop(dx), 6) + 0.0 AS beta FROM d WHERE dx IS NOT NULL GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.stats import difference_beta
    from tidegauge.plans.series import Series, framed

    base = v.bars.filter("symbol = 'S0'").select("ts", F.col("close").alias("x"))
    j = base.join(v.bars.filter("symbol <> 'S0'").select("symbol", "ts", F.col("close").alias("y")), "ts")

    def build(d, b):
        return d.withColumns({"dx": F.col("x") - F.lag("x").over(b.w), "dy": F.col("y") - F.lag("y").over(b.w)})

    d = framed(j, Series(("symbol",), "ts", (), 30 * 86_400), build, back=1).filter("dx IS NOT NULL")
    return rounded(difference_beta(d, ["symbol"], "dx", "dy"), "corr", "beta")


@query(
    "horizon_curve_fixed_scores",
    "I25 D25 E34",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, volume, unnest([1, 4, 12]) AS h, unnest([lead(close, 1) OVER w, lead(close, 4) OVER w, lead(close, 12) OVER w]) / close - 1 AS ret FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      rk AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY volume DESC, epoch_us(ts) * 10 + CAST(substr(symbol, 2) AS BIGINT)) AS rn, count(*) OVER (PARTITION BY h) AS n FROM x WHERE ret IS NOT NULL)
      SELECT h, count(*) FILTER (rn <= ceil(n * 0.1)) AS n_top, round(avg(ret) FILTER (rn <= ceil(n * 0.1)) - {COST}, 7) + 0.0 AS pss FROM rk GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.events import forward_returns
    from tidegauge.sources.views import BAR_SERIES

    ev = forward_returns(v.bars, BAR_SERIES, (1, 4, 12))
    ev = ev.withColumn("id", F.unix_micros("ts") * 10 + F.substring("symbol", 2, 1).cast("long"))
    out = S.top_premium(ev, ["h"], "volume", "ret", "id", COST)
    return out.select("h", "n_top", r("pss", 7).alias("pss"))


@query(
    "seed_direction_consistency",
    "K17 D22",
    f"""WITH {SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY cell, id % 3 ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY cell, id % 3) AS n FROM scores),
      p AS (SELECT cell, id % 3 AS seed, avg(fwd) - {COST} AS pss FROM rk WHERE rn <= ceil(n * 0.1) GROUP BY 1, 2)
      SELECT cell, count(*) AS n_seeds, round(avg(CASE WHEN pss > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS frac, avg(CASE WHEN pss > 0 THEN 1.0 ELSE 0 END) >= 2 / 3.0 AS passed FROM p GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.gates import direction_consistency

    p = S.top_premium(v.scores.withColumn("seed", F.col("id") % 3), ["cell", "seed"], "score", "fwd", "id", COST)
    return rounded(direction_consistency(p, ["cell"], "pss"), "frac")


@query(
    "order_flow_decay",
    "K15 D21 E23",
    f"""WITH {TICKS}, s AS (SELECT symbol, date_trunc('minute', ts) AS ts, sum(CASE WHEN buyer_maker THEN -1.0 ELSE 1.0 END * qty) AS sg, sum(qty) AS vol, arg_max(price, ts) AS px FROM ticks GROUP BY 1, 2),
      i AS (SELECT symbol, ts, px, sum(sg) OVER r / sum(vol) OVER r AS imb FROM s WINDOW r AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 119 MINUTE PRECEDING AND CURRENT ROW)),
      f AS (SELECT i.*, n.px / i.px - 1 AS ret FROM i ASOF JOIN s n ON n.symbol = i.symbol AND n.ts >= i.ts + INTERVAL 1 HOUR),
      e AS (SELECT list_distinct([quantile_cont(imb, 0), quantile_cont(imb, 0.2), quantile_cont(imb, 0.4), quantile_cont(imb, 0.6), quantile_cont(imb, 0.8), quantile_cont(imb, 1)]) AS es FROM f)
      SELECT CAST(greatest(0, len(list_filter(es, lambda x: x < imb)) - 1) AS BIGINT) AS bucket, count(*) AS n, round(avg(ret) * 1e4, 3) + 0.0 AS mean_bp FROM f, e GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.orderflow import decay_table
    from tidegauge.sources.views import BAR_SERIES

    out = decay_table(v.ticks, BAR_SERIES, step=60, window=7200, horizon=3600, q=5)
    return out.select("bucket", "n", r("mean_bp", 3).alias("mean_bp"))
