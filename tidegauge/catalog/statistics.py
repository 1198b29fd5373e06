"""Tests over tables: I5-I11, I23, K16, K25."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SCORES, TRADES, query, r, rounded
from tidegauge.operators import stats as T

N = 4000  # Simpson intervals of the numeric tails below


def _simpson(density: str, upper: str, keys: str, src: str, out: str) -> str:
    """Common table: integral of ``density`` (in x) from 0 to ``upper`` for every row of ``src``."""
    return (
        f"{out}_g AS (SELECT s.*, i, {upper} * i / {N}.0 AS x FROM {src} s, range(0, {N + 1}) r(i)), "
        f"{out} AS (SELECT {keys}, sum(CASE WHEN i = 0 OR i = {N} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}) * any_value({upper}) / {3 * N}.0 AS area FROM {out}_g GROUP BY {keys})"
    )


T_DENSITY = "exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0)) / sqrt(dof * pi()) * pow(1 + x * x / dof, -(dof + 1) / 2.0)"


@query(
    "event_theta_metrics",
    "I5",
    f"""WITH {SCORES} SELECT cell, count(*) AS n, round(avg(fwd) / stddev_samp(fwd) * sqrt(count(*) / 7.0), 6) + 0.0 AS theta, round(avg(fwd), 7) + 0.0 AS mean_net,
      round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS win_rate, round(sum(fwd) FILTER (fwd > 0) / -sum(fwd) FILTER (fwd < 0), 6) + 0.0 AS profit_factor FROM scores GROUP BY 1""",
)
def _(v):
    out = T.event_theta(v.scores, ["cell"], "fwd", 7.0)
    return rounded(out.withColumn("mean_net", r("mean_net", 7)), "theta", "win_rate", "profit_factor")


@query(
    "one_sample_t_statistic",
    "I7 I6",
    f"""WITH {SCORES} SELECT cell, count(*) AS n_x, round((avg(fwd) - 0.003) / (stddev_samp(fwd) / sqrt(count(*))), 6) + 0.0 AS t,
      round((avg(fwd) - 0.003) / stddev_samp(fwd), 6) + 0.0 AS d FROM scores GROUP BY 1""",
)
def _(v):
    return rounded(T.one_sample_t(v.scores, ["cell"], F.col("fwd"), 0.003).select("cell", "n_x", "t", "d"), "t", "d")


@query(
    "one_sample_t_pvalue",
    "I7",
    f"""WITH {SCORES}, m AS (SELECT cell, count(*) AS n_x, avg(fwd) AS mean_x, stddev_samp(fwd) AS sd_x, (avg(fwd) - 0.003) / (stddev_samp(fwd) / sqrt(count(*))) AS t, count(*) - 1 AS dof FROM scores GROUP BY 1),
      {_simpson(T_DENSITY, 't', 'cell', 'm', 'a')}
      SELECT cell, n_x, round(mean_x, 6) + 0.0 AS mean_x, round(sd_x, 6) + 0.0 AS sd_x, round(t, 6) + 0.0 AS t, round((mean_x - 0.003) / sd_x, 6) + 0.0 AS d, round(0.5 - area, 6) + 0.0 AS p FROM m JOIN a USING (cell)""",
)
def _(v):
    return rounded(T.one_sample_t(v.scores, ["cell"], F.col("fwd"), 0.003), "mean_x", "sd_x", "t", "d", "p")


@query(
    "paired_t_and_dz",
    "I7 I6",
    f"""WITH {BARS}, p AS (SELECT a.symbol, a.high - a.close AS u, a.close - a.low AS d FROM bars a)
      SELECT symbol, count(*) AS n_x, round(CASE WHEN stddev_samp(u - d) > 0 THEN avg(u - d) / (stddev_samp(u - d) / sqrt(count(*))) ELSE 0 END, 6) + 0.0 AS t,
        round(CASE WHEN stddev_samp(u - d) > 0 THEN avg(u - d) / stddev_samp(u - d) ELSE 0 END, 6) + 0.0 AS d FROM p GROUP BY 1""",
)
def _(v):
    d = v.bars.select("symbol", (F.col("high") - F.col("close")).alias("u"), (F.col("close") - F.col("low")).alias("dn"))
    return rounded(T.paired_t(d, ["symbol"], "u", "dn").select("symbol", "n_x", "t", "d"), "t", "d")


@query(
    "welch_t_and_df",
    "I7 I6",
    f"""WITH {TRADES}, m AS (SELECT line, count(*) FILTER (status = 'O') AS na, avg(profit_ratio) FILTER (status = 'O') AS ma, var_samp(profit_ratio) FILTER (status = 'O') AS va,
        count(*) FILTER (status <> 'O') AS nb, avg(profit_ratio) FILTER (status <> 'O') AS mb, var_samp(profit_ratio) FILTER (status <> 'O') AS vb FROM trades GROUP BY 1)
      SELECT line, na AS n_a, nb AS n_b, round((ma - mb) / sqrt(va / na + vb / nb), 6) + 0.0 AS t,
       round((va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)), 3) + 0.0 AS dof,
       round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) + 0.0 AS cohens_d FROM m""",
)
def _(v):
    out = T.welch(v.trades, ["line"], "profit_ratio", F.col("status") == "O")
    return rounded(out.select("line", "n_a", "n_b", "t", r("dof", 3).alias("dof"), "cohens_d"), "t", "cohens_d")


WELCH = f"""{TRADES}, m AS (SELECT line, count(*) FILTER (status = 'O') AS na, avg(profit_ratio) FILTER (status = 'O') AS ma, var_samp(profit_ratio) FILTER (status = 'O') AS va,
        count(*) FILTER (status <> 'O') AS nb, avg(profit_ratio) FILTER (status <> 'O') AS mb, var_samp(profit_ratio) FILTER (status <> 'O') AS vb FROM trades GROUP BY 1),
      q AS (SELECT line, ma - mb AS diff, (ma - mb) / sqrt(va / na + vb / nb) AS t,
       (va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)) AS dof FROM m)"""


@query(
    "welch_pvalue",
    "I7",
    f"""WITH {WELCH}, {_simpson(T_DENSITY, 'abs(t)', 'line', 'q', 'a')}
      SELECT line, round(diff, 7) + 0.0 AS diff, round(1 - 2 * area, 6) + 0.0 AS p FROM q JOIN a USING (line)""",
)
def _(v):
    out = T.welch(v.trades, ["line"], "profit_ratio", F.col("status") == "O")
    return out.select("line", r("diff", 7).alias("diff"), r("p").alias("p"))


@query("welch_interval", "I7")
def _(v):
    out = T.welch(v.trades, ["line"], "profit_ratio", F.col("status") == "O")
    return rounded(out.select("line", "diff", "ci_lo", "ci_hi"), "diff", "ci_lo", "ci_hi")


@query(
    "mann_whitney_cliff_delta",
    "I8 K25",
    f"""WITH {TRADES}, k AS (SELECT line, status, profit_ratio, rank() OVER (PARTITION BY line ORDER BY profit_ratio) + (count(*) OVER (PARTITION BY line, profit_ratio) - 1) / 2.0 AS rk,
         count(*) OVER (PARTITION BY line, profit_ratio) AS t FROM trades),
      m AS (SELECT line, sum(rk) FILTER (status = 'O') AS ra, count(*) FILTER (status = 'O') AS na, count(*) FILTER (status <> 'O') AS nb, sum(CAST(t AS DOUBLE) * t - 1) AS tt, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY 1),
      u AS (SELECT *, ra - na * (na + 1) / 2.0 AS u FROM m)
      SELECT line, na AS n_a, nb AS n_b, round(u, 3) + 0.0 AS u, round(2 * u / (CAST(na AS DOUBLE) * nb) - 1, 6) + 0.0 AS cliff_delta,
        round((greatest(u, CAST(na AS DOUBLE) * nb - u) - CAST(na AS DOUBLE) * nb / 2 - 0.5) / sqrt(CAST(na AS DOUBLE) * nb / 12 * ((n + 1) - tt / (n * (n - 1)))), 6) + 0.0 AS z FROM u""",
)
def _(v):
    out = T.mann_whitney(v.trades, ["line"], "profit_ratio", F.col("status") == "O").drop("p")
    return rounded(out.withColumn("u", r("u", 3)), "cliff_delta", "z")


@query(
    "mann_whitney_pvalue",
    "I8 K25",
    f"""WITH {TRADES}, k AS (SELECT line, status, profit_ratio, rank() OVER (PARTITION BY line ORDER BY profit_ratio) + (count(*) OVER (PARTITION BY line, profit_ratio) - 1) / 2.0 AS rk,
         count(*) OVER (PARTITION BY line, profit_ratio) AS t FROM trades),
      m AS (SELECT line, sum(rk) FILTER (status = 'O') AS ra, CAST(count(*) FILTER (status = 'O') AS DOUBLE) AS na, CAST(count(*) FILTER (status <> 'O') AS DOUBLE) AS nb, sum(CAST(t AS DOUBLE) * t - 1) AS tt, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY 1),
      u AS (SELECT *, ra - na * (na + 1) / 2.0 AS u FROM m),
      z AS (SELECT line, greatest(0, (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * ((n + 1) - tt / (n * (n - 1))))) AS z FROM u),
      {_simpson('exp(-x * x / 2) / sqrt(2 * pi())', 'z', 'line', 'z', 'a')}
      SELECT line, round(1 - 2 * area, 6) + 0.0 AS p FROM a""",
)
def _(v):
    return rounded(T.mann_whitney(v.trades, ["line"], "profit_ratio", F.col("status") == "O"), "p").select("line", "p")


@query(
    "sign_test_counts",
    "I9",
    f"""WITH {TRADES} SELECT pair, count(*) FILTER (profit_ratio > 0) AS k, count(*) AS n, round(count(*) FILTER (profit_ratio > 0) / count(*), 6) + 0.0 AS frac FROM trades GROUP BY 1""",
)
def _(v):
    return rounded(T.sign_test(v.trades, ["pair"], "profit_ratio").drop("p"), "frac")


@query(
    "sign_test_pvalue",
    "I9",
    f"""WITH {TRADES}, c AS (SELECT pair, count(*) FILTER (profit_ratio > 0) AS k, count(*) AS n FROM trades GROUP BY 1),
      s AS (SELECT pair, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) AS low FROM (SELECT pair, k, n, unnest(range(0, least(k, n - k) + 1)) AS i FROM c) GROUP BY 1)
      SELECT pair, k, n, round(k / n, 6) + 0.0 AS frac, round(CASE WHEN 2 * k = n THEN 1 ELSE least(1.0, 2 * low) END, 6) + 0.0 AS p FROM c JOIN s USING (pair)""",
)
def _(v):
    return rounded(T.sign_test(v.trades, ["pair"], "profit_ratio"), "frac", "p")


@query(
    "bh_fdr_by_family",
    "I10",
    f"""WITH {TRADES}, p AS (SELECT pair, date_trunc('month', close_date) AS m, round(count(*) FILTER (profit_ratio > 0) / count(*), 9) AS p FROM trades GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY p, m) AS rk, count(*) OVER (PARTITION BY pair) AS n FROM p),
      q AS (SELECT *, least(1.0, min(p * n / rk) OVER (PARTITION BY pair ORDER BY rk DESC)) AS q FROM k)
      SELECT pair, epoch_ms(m) AS month_ms, p, round(q, 7) + 0.0 AS q, q < 0.5 AS passed FROM q""",
)
def _(v):
    month = F.date_trunc("month", "close_date").alias("m")
    share = F.round(F.avg((F.col("profit_ratio") > 0).cast("double")), 9)
    p = v.trades.groupBy("pair", month).agg(share.alias("p"))
    q = T.bh_adjust(p, ["pair"], "p", "m")
    return q.select("pair", F.unix_millis("m").alias("month_ms"), "p", r("q", 7).alias("q"), (F.col("q") < 0.5).alias("passed"))


@query("power_table", "I11 I6")
def _(v):
    e = T.one_sample_t(v.scores, ["cell"], F.col("fwd"), 0.003)
    out = T.power_table(e.withColumn("n", F.col("n_x")), ["cell"], "d", "n")
    return rounded(out, "d", "power_two_sample", "power_one_sample")


@query(
    "effect_size_variants",
    "I6",
    f"""WITH {TRADES}, m AS (SELECT line, avg(profit_ratio) FILTER (status = 'O') AS ma, var_samp(profit_ratio) FILTER (status = 'O') AS va,
       avg(profit_ratio) FILTER (status <> 'O') AS mb, var_samp(profit_ratio) FILTER (status <> 'O') AS vb FROM trades GROUP BY 1)
      SELECT line, round((ma - mb) / sqrt((va + vb) / 2), 6) + 0.0 AS d_simple FROM m""",
)
def _(v):
    a = F.col("status") == "O"
    m = v.trades.groupBy("line").agg(
        *T.moments(F.when(a, F.col("profit_ratio")), "a"), *T.moments(F.when(~a, F.col("profit_ratio")), "b")
    )
    return m.select("line", r(T.simple_d("a", "b")).alias("d_simple"))


@query(
    "two_group_run_comparison",
    "K25 D31 D32",
    f"""WITH {TRADES}, runs AS (SELECT order_id % 50 AS run, status, sum(profit_abs) AS net, count(*) AS n FROM trades GROUP BY 1, 2)
      SELECT status, count(*) AS runs, round(quantile_cont(net, 0.5), 4) + 0.0 AS median_net, round(avg(net), 3) + 0.0 AS mean_net, count(*) FILTER (net < 0) AS losing FROM runs GROUP BY 1""",
)
def _(v):
    from tidegauge.plans.ranking import exact_quantiles

    runs = v.trades.groupBy((F.col("order_id") % 50).alias("run"), "status").agg(F.sum("profit_abs").alias("net"))
    g = runs.groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"), r(F.avg("net"), 3).alias("mean_net"), F.count_if(F.col("net") < 0).alias("losing")
    )
    med = exact_quantiles(runs, ["status"], "net", {"median_net": 0.5})
    return g.join(rounded(med, "median_net", digits=4), "status")
