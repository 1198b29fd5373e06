"""Bootstraps and Monte-Carlo controls: I16-I23, I26.

Draws are integer arithmetic on row ids, so the oracle repeats them exactly.
A query with SQL has the few replicates that the SQL text names; beside it the same
query ends in ``_published`` and draws the published number (and block length).
"""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, SCORES, TRADES, query, r, rounded
from tidegauge.functions.rand import sql_draws, sql_poisson, sql_poisson_of
from tidegauge.operators import resampling as R
from tidegauge.plans.series import Series
from tidegauge.plans.stage import materialise

Q = "quantile_cont({x}, 0.025)", "quantile_cont({x}, 0.975)"


def _ci(x: str, src: str, by: str = "", digits: int = 7) -> str:
    g = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {g}round(avg({x}), {digits}) + 0.0 AS boot_mean, round(quantile_cont({x}, 0.025), {digits}) + 0.0 AS lo, "
        f"round(quantile_cont({x}, 0.975), {digits}) + 0.0 AS hi FROM {src}{tail}"
    )


def _row_diff_sql(reps: int) -> str:
    return f"""WITH {SCORES}, rp AS (SELECT s.cell, s.id, s.fwd, s.label, r.i AS rep FROM scores s CROSS JOIN range(0, {reps}) r(i)),
      {sql_draws('rp', 'id', 'rep', 11, 'dr')}, w AS (SELECT *, {sql_poisson('u')} AS w FROM dr),
      d AS (SELECT cell, rep, sum(w * score_x) FILTER (a) / sum(w) FILTER (a) - sum(w * score_x) FILTER (NOT a) / sum(w) FILTER (NOT a) AS diff
        FROM (SELECT *, fwd AS score_x, id % 2 = 0 AS a FROM w) GROUP BY 1, 2)
      {_ci('diff', 'd', 'cell')}"""


def _diff_sql(reps: int) -> str:
    """Rows of one cell, side and value weigh together, 4 096 rows a draw."""
    return f"""WITH {SCORES}, g AS (SELECT cell, id % 2 = 0 AS a, fwd, min(id) AS lid, count(*) AS n FROM scores GROUP BY 1, 2, 3),
      gp AS (SELECT *, unnest(range(0, (n - 1) // 4096 + 1)) AS piece FROM g), pc AS (SELECT * REPLACE (least(4096, n - piece * 4096) AS n) FROM gp),
      rp AS (SELECT pc.*, r.i AS rep FROM pc CROSS JOIN range(0, {reps}) r(i)),
      {sql_draws("rp", "lid + piece * 1000000007", "rep", 11, "dr")}, {sql_poisson_of("dr", "n", "u", "w")},
      d AS (SELECT cell, rep, sum(w * fwd) FILTER (a) / sum(w) FILTER (a) - sum(w * fwd) FILTER (NOT a) / sum(w) FILTER (NOT a) AS diff FROM w GROUP BY 1, 2)
      {_ci("diff", "d", "cell")}"""


@query("bootstrap_mean_difference", "I16", _row_diff_sql(100))
def _(v, reps=100, each=True):
    d = R.mean_diff_draws(v.scores, ["cell"], "fwd", F.col("id") % 2 == 0, "id", reps, 11, each)
    return rounded(R.interval(d, ["cell"], "diff"), "boot_mean", "lo", "hi", digits=7)


query("bootstrap_mean_difference_published", "I16", _diff_sql(2000))(lambda v, f=_: f(v, 2000, False))


def _row_premium_sql(reps: int) -> str:
    return f"""WITH {SCORES}, s2 AS (SELECT *, ((id % 7919) * 31 + id % 104729) / 1e6 AS other FROM scores),
      rp AS (SELECT s.*, r.i AS rep FROM s2 s CROSS JOIN range(0, {reps}) r(i)),
      {sql_draws('rp', 'id', 'rep', 17, 'dr')}, w AS (SELECT *, {sql_poisson('u')} AS w FROM dr),
      k AS (SELECT rep, ceil(sum(w) * 0.1) AS k FROM w GROUP BY 1),
      c AS (SELECT w.rep, fwd, w, k, sum(w) OVER (PARTITION BY w.rep ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) - w AS ba,
        sum(w) OVER (PARTITION BY w.rep ORDER BY other DESC, id ROWS UNBOUNDED PRECEDING) - w AS bb FROM w JOIN k ON w.rep = k.rep),
      t AS (SELECT rep, sum(greatest(0, least(w, k - bb)) * fwd) / max(k) - sum(greatest(0, least(w, k - ba)) * fwd) / max(k) AS delta FROM c GROUP BY 1)
      {_ci('delta', 't', digits=6)}"""


def _premium_sql(reps: int) -> str:
    """Rows near one of the cuts weigh one by one; all others as cells of equal outcome, 4 096 rows a draw."""
    near = f"CAST(ceil(8 * sqrt(n * {0.1 * (1 - 0.1)!r}::DOUBLE)) AS BIGINT) + 50"
    side = lambda c: f"CASE WHEN r{c} <= mid - half THEN 0 WHEN r{c} <= mid + half THEN 1 ELSE 2 END AS c{c}"
    top = lambda c: f"(sum(CASE WHEN c{c} = 0 THEN w * fwd WHEN c{c} = 1 THEN greatest(0, least(w, k - b{c})) * fwd ELSE 0 END) / max(k))"
    before = lambda c: f"sum(CASE WHEN c{c} < 2 THEN w ELSE 0 END) OVER (PARTITION BY rep ORDER BY c{c}, CASE WHEN c{c} = 1 THEN r{c} ELSE 0 END, lid, piece ROWS UNBOUNDED PRECEDING) - w AS b{c}"
    return f"""WITH {SCORES}, s2 AS (SELECT id, fwd, row_number() OVER (ORDER BY score DESC, id) AS ra,
        row_number() OVER (ORDER BY ((id % 7919) * 31 + id % 104729) / 1e6 DESC, id) AS rb, count(*) OVER () AS n FROM scores),
      s3 AS (SELECT *, {near} AS half, CAST(ceil(n * 0.1::DOUBLE - 1e-9) AS BIGINT) AS mid FROM s2), s4 AS (SELECT *, {side("a")}, {side("b")} FROM s3),
      g AS (SELECT ca, cb, fwd, min(ra) AS ra, min(rb) AS rb, min(id) AS lid, count(*) AS n FROM s4 GROUP BY ca, cb, fwd, CASE WHEN ca = 1 OR cb = 1 THEN id END),
      gp AS (SELECT *, unnest(range(0, (n - 1) // 4096 + 1)) AS piece FROM g), pc AS (SELECT * REPLACE (least(4096, n - piece * 4096) AS n) FROM gp),
      rp AS (SELECT pc.*, r.i AS rep FROM pc CROSS JOIN range(0, {reps}) r(i)),
      {sql_draws("rp", "lid + piece * 1000000007", "rep", 17, "dr")}, {sql_poisson_of("dr", "n", "u", "dw")},
      w AS MATERIALIZED (SELECT ca, cb, ra, rb, lid, piece, fwd, rep, w FROM dw), k AS (SELECT rep, ceil(sum(w) * 0.1::DOUBLE - 1e-9) AS k FROM w GROUP BY 1),
      c AS (SELECT w.*, k, {before("a")}, {before("b")} FROM w JOIN k USING (rep)),
      t AS (SELECT rep, {top("b")} - {top("a")} AS delta FROM c GROUP BY 1)
      {_ci("delta", "t", digits=6)}"""


@query("paired_bootstrap_premium_difference", "I17", _row_premium_sql(40))
def _(v, reps=40, each=True):
    s = v.scores.withColumn("other", ((F.col("id") % 7919) * 31 + F.col("id") % 104729) / 1e6)
    d = R.premium_difference(s, "score", "other", "fwd", "id", reps, 17, each=each)
    return rounded(R.interval(d, [], "delta"), "boot_mean", "lo", "hi")


query("paired_bootstrap_premium_difference_published", "I17", _premium_sql(10000))(lambda v, f=_: f(v, 10000, False))


@query(
    "moving_block_theta",
    "I18 I5",
    f"""WITH {BARS}, x AS (SELECT symbol, pos, close / open - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM nb),
      b AS (SELECT symbol, pos, n, count(r) OVER f AS c, sum(r) OVER f AS s1, sum(r * r) OVER f AS s2 FROM x WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
      e AS (SELECT symbol, max(n) AS n FROM x GROUP BY 1),
      rp AS (SELECT e.symbol, e.n, r.i AS rep, unnest(range(0, CAST(ceil(e.n / 24.0) AS BIGINT))) AS i FROM e CROSS JOIN range(0, 200) r(i)),
      {sql_draws('rp', 'i', 'rep', 18, 'dr')},
      p AS (SELECT symbol, rep, CAST(floor(u * (n - 24 + 1)) AS BIGINT) AS pos FROM dr),
      g AS (SELECT p.symbol, rep, sum(c) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM p JOIN b ON p.symbol = b.symbol AND p.pos = b.pos WHERE c = 24 GROUP BY 1, 2),
      t AS (SELECT symbol, rep, s1 / n / sqrt((s2 - s1 * s1 / n) / (n - 1)) * sqrt(365) AS theta FROM g)
      {_ci('theta', 't', 'symbol', 6)}""",
)
def _(v, reps=200, k=24):
    d = v.bars.select("symbol", "ts", (F.col("close") / F.col("open") - 1).alias("r"))
    t = R.moving_block_theta(d, Series(("symbol",), "ts", (), 30 * 86_400), "r", k, reps, 18, 365.0)
    return rounded(R.interval(t, ["symbol"], "theta"), "boot_mean", "lo", "hi")


query("moving_block_theta_published", "I18 I5")(lambda v, f=_: f(v, 10000, 500))


@query(
    "calendar_week_block_theta",
    "I19 H2",
    f"""WITH {TRADES}, b AS (SELECT pair, isoyear(close_date) || '-W' || lpad(CAST(week(close_date) AS VARCHAR), 2, '0') AS wk, count(*) AS c, sum(profit_ratio) AS s1, sum(profit_ratio * profit_ratio) AS s2 FROM trades GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY wk) - 1 AS pos, count(*) OVER (PARTITION BY pair) AS m FROM b),
      rp AS (SELECT k.pair, k.pos AS i, k.m, r.i AS rep FROM k CROSS JOIN range(0, 200) r(i)),
      {sql_draws('rp', 'i', 'rep', 19, 'dr')},
      p AS (SELECT pair, rep, CAST(floor(u * m) AS BIGINT) AS pos FROM dr),
      g AS (SELECT p.pair, rep, sum(c) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM p JOIN k ON p.pair = k.pair AND p.pos = k.pos GROUP BY 1, 2),
      t AS (SELECT pair, rep, s1 / n / sqrt((s2 - s1 * s1 / n) / (n - 1)) * sqrt(365) AS theta FROM g)
      {_ci('theta', 't', 'pair', 6)}""",
)
def _(v, reps=200):
    week = F.concat(
        F.extract(F.lit("YEAROFWEEK"), F.col("close_date")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("close_date").cast("string"), 2, "0")
    )
    t = R.calendar_block_theta(v.trades, ["pair"], week, "profit_ratio", reps, 19, 365.0)
    return rounded(R.interval(t, ["pair"], "theta"), "boot_mean", "lo", "hi")


query("calendar_week_block_theta_published", "I19 H2")(lambda v, f=_: f(v, 10000))


@query(
    "cluster_bootstrap_mean",
    "I20 I23",
    f"""WITH {TRADES}, s AS (SELECT pair, line, quantile_cont(profit_ratio, 0.5) - avg(profit_ratio) AS d FROM trades GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY line) - 1 AS pos, count(*) OVER (PARTITION BY pair) AS m FROM s),
      rp AS (SELECT k.pair, k.pos AS i, k.m, r.i AS rep FROM k CROSS JOIN range(0, 500) r(i)),
      {sql_draws('rp', 'i', 'rep', 20, 'dr')},
      t AS (SELECT p.pair, p.rep, avg(k.d) AS stat FROM (SELECT pair, rep, CAST(floor(u * m) AS BIGINT) AS pos FROM dr) p JOIN k ON p.pair = k.pair AND p.pos = k.pos GROUP BY 1, 2)
      {_ci('stat', 't', 'pair')}""",
)
def _(v, reps=500):
    from tidegauge.plans.ranking import exact_quantiles

    # trades are read once: rows of one cluster and result are one row, which holds their number
    merged = v.trades.filter("profit_ratio IS NOT NULL").groupBy("pair", "line", "profit_ratio").agg(F.count(F.lit(1)).alias("n"))
    merged = materialise(merged, "clusters")
    med = exact_quantiles(merged, ["pair", "line"], "profit_ratio", {"med": 0.5}, F.col("n"))
    mean = (F.sum(F.col("profit_ratio") * F.col("n")) / F.sum("n")).alias("m")
    s = merged.groupBy("pair", "line").agg(mean).join(med, ["pair", "line"])
    s = s.select("pair", "line", (F.col("med") - F.col("m")).alias("d"))
    t = R.cluster_mean_draws(s, ["pair"], "line", "d", reps, 20)
    return rounded(R.interval(t, ["pair"], "stat"), "boot_mean", "lo", "hi", digits=7)


query("cluster_bootstrap_mean_published", "I20 I23")(lambda v, f=_: f(v, 10000))


@query(
    "resampled_sharpe_interval",
    "I21",
    f"""WITH {TRADES}, d AS (SELECT pair, CAST(close_date AS DATE) AS day, sum(profit_ratio) AS r FROM trades GROUP BY 1, 2),
      rp AS (SELECT d.pair, d.r AS x, date_diff('day', DATE '1970-01-01', day) AS i, q.i AS rep FROM d CROSS JOIN range(0, 100) q(i)),
      {sql_draws('rp', 'i', 'rep', 21, 'dr')}, w AS (SELECT pair, rep, x, {sql_poisson('u')} AS w FROM dr),
      g AS (SELECT pair, rep, sum(w) AS n, sum(w * x) AS s1, sum(w * x * x) AS s2 FROM w GROUP BY 1, 2),
      t AS (SELECT pair, rep, s1 / n / sqrt((s2 - s1 * s1 / n) / (n - 1)) * sqrt(365) AS sharpe FROM g)
      {_ci('sharpe', 't', 'pair', 6)}""",
)
def _(v, reps=100):
    d = v.trades.groupBy("pair", F.to_date("close_date").alias("day")).agg(F.sum("profit_ratio").alias("r"))
    d = d.withColumn("row", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long"))
    t = R.ratio_draws(d, ["pair"], "r", "row", reps, 21, 365.0)
    return rounded(R.interval(t, ["pair"], "sharpe"), "boot_mean", "lo", "hi")


query("resampled_sharpe_interval_published", "I21")(lambda v, f=_: f(v, 10000))


@query(
    "matched_control_monte_carlo",
    "I22",
    f"""WITH {BARS}, f AS (SELECT symbol, ts, epoch_us(ts) * 10 + CAST(substr(symbol, 2) AS BIGINT) AS id, CASE WHEN close > 160 THEN 'high' WHEN close < 125 THEN 'low' ELSE 'mid' END AS regime,
        volume, lead(close, 12) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS ret FROM nb),
      pool AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY id) AS pos, count(*) OVER (PARTITION BY regime) AS size FROM f WHERE ret IS NOT NULL),
      ev AS (SELECT symbol, regime, count(*) AS want, sum(ret) AS sr FROM pool WHERE volume > 150 GROUP BY 1, 2),
      ob AS (SELECT symbol, sum(sr) / sum(want) AS obs FROM ev GROUP BY 1),
      sz AS (SELECT regime, max(size) AS size FROM pool GROUP BY 1),
      rp AS (SELECT e.symbol, e.regime, s.size, r.i AS rep, unnest(range(0, e.want)) AS i FROM ev e JOIN sz s ON e.regime = s.regime CROSS JOIN range(0, 200) r(i)),
      {sql_draws('rp', 'i', 'rep', 22, 'dr')},
      c AS (SELECT d.symbol, d.rep, avg(p.ret) AS ctrl FROM (SELECT symbol, regime, rep, CAST(floor(u * size) AS BIGINT) + 1 AS pos FROM dr) d JOIN pool p ON p.regime = d.regime AND p.pos = d.pos GROUP BY 1, 2)
      SELECT symbol, round(avg(CASE WHEN ctrl >= obs THEN 1.0 ELSE 0 END), 6) + 0.0 AS mc_p, round(max(obs), 6) + 0.0 AS obs, round(avg(ctrl), 6) + 0.0 AS ctrl_mean FROM c JOIN ob USING (symbol) GROUP BY 1""",
)
def _(v, reps=200):
    from tidegauge.operators import windows as w
    from tidegauge.plans.series import framed
    from tidegauge.sources.views import BAR_SERIES

    c = F.col("close")
    f = framed(v.bars, BAR_SERIES, lambda d, b: d.withColumn("ret", w.forward_return(b, c, 12)), ahead=12)
    f = f.filter("ret IS NOT NULL").select(
        "symbol", (F.unix_micros("ts") * 10 + F.substring("symbol", 2, 1).cast("long")).alias("id"),
        F.when(c > 160, "high").when(c < 125, "low").otherwise("mid").alias("regime"), "volume", "ret",
    )
    f = materialise(f, "control")
    ev = f.filter("volume > 150")
    draws = R.matched_control(f, ev, ["symbol"], "regime", "ret", "id", reps, 22)
    obs = ev.groupBy("symbol").agg(F.avg("ret").alias("obs"))
    return rounded(R.control_p_value(draws, obs, ["symbol"], "obs"), "mc_p", "obs", "ctrl_mean")


query("matched_control_monte_carlo_published", "I22")(lambda v, f=_: f(v, 2000))


@query(
    "random_entry_reference",
    "I26 D26",
    f"""WITH {SCORES}, rp AS (SELECT *, 0 AS rep FROM scores), {sql_draws('rp', 'id', 'rep', 26, 'dr')},
      s AS (SELECT * FROM dr ORDER BY u, id LIMIT 5000)
      SELECT count(*) AS n, round(avg(fwd), 7) + 0.0 AS mean, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS p_pos FROM s""",
)
def _(v):
    s = R.random_reference(v.scores, "id", 5000, 26)
    return s.agg(F.count(F.lit(1)).alias("n"), r(F.avg("fwd"), 7).alias("mean"), r(F.avg((F.col("fwd") > 0).cast("double"))).alias("p_pos"))
