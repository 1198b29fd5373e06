"""Joins: C1-C13, C15, C19, C21, C24-C28, G1, G3, G4."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import ACTIONS, BARS, SETTLEMENTS, SNAPSHOTS, TICKS, TRADES, ms, query, r, rounded
from tidegauge.operators import events, joins, windows as w
from tidegauge.plans.series import Series
from tidegauge.plans.stage import materialise
from tidegauge.sources.views import BAR_SERIES, TICK_SERIES

WSQL = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
TS = Series(("symbol",), "ts", (), span=21_600)


@query(
    "join_bars_signals_inner",
    "C1 G4",
    f"""WITH {BARS}, sig AS (SELECT symbol, date_trunc('hour', ts) AS ts, max(value) AS sig FROM ticks
        WHERE event_type = 'click' GROUP BY 1, 2)
      SELECT symbol, epoch_ms(ts) AS ts_ms, close, sig FROM bars JOIN sig USING (symbol, ts)""",
)
def _(v):
    from tidegauge.operators.bars import bucket

    sig = v.ticks.filter(F.col("event_type") == "click").groupBy("symbol", bucket("ts", 3600).alias("ts"))
    return v.bars.join(sig.agg(F.max("value").alias("sig")), ["symbol", "ts"]).select(
        "symbol", ms("ts").alias("ts_ms"), "close", "sig"
    )


@query(
    "join_left_lookup_by_ms",
    "C2 H1",
    f"""WITH {BARS} SELECT a.symbol, epoch_ms(a.ts) AS ts_ms, b.close AS base_close FROM bars a
      LEFT JOIN bars b ON b.symbol = 'S0' AND epoch_ms(a.ts) = epoch_ms(b.ts)""",
)
def _(v):
    base = v.bars.filter(F.col("symbol") == "S0").select(ms("ts").alias("ts_ms"), F.col("close").alias("base_close"))
    return v.bars.select("symbol", ms("ts").alias("ts_ms")).join(base, "ts_ms", "left")


@query(
    "asof_backward_funding",
    "C5 L6",
    f"""WITH {TICKS}, {SETTLEMENTS} SELECT t.agg_id, s.rate, epoch_us(s.ts) // 1000 AS settled_ms
      FROM ticks t ASOF LEFT JOIN settlements s ON t.symbol = s.symbol AND t.ts >= s.ts""",
)
def _(v):
    out = joins.asof(v.ticks.select("symbol", "ts", "agg_id"), v.settlements, TS, ["rate"], stamp="at")
    return out.select("agg_id", "rate", ms("at").alias("settled_ms"))


@query(
    "asof_forward_snapshot",
    "C6",
    f"""WITH {TICKS}, {SNAPSHOTS} SELECT t.agg_id, s.oi, epoch_us(s.ts) // 1000 AS seen_ms
      FROM ticks t ASOF LEFT JOIN snapshots s ON t.symbol = s.symbol AND t.ts <= s.ts""",
)
def _(v):
    out = joins.asof(v.ticks.select("symbol", "ts", "agg_id"), v.snapshots, TS, ["oi"], "forward", stamp="at")
    return out.select("agg_id", "oi", ms("at").alias("seen_ms"))


@query(
    "asof_forward_clipped_to_last",
    "C7",
    f"""WITH {BARS}, {SETTLEMENTS}, f AS (SELECT s.symbol, s.ts, b.close FROM settlements s ASOF LEFT JOIN bars b
        ON s.symbol = b.symbol AND s.ts <= b.ts), z AS (SELECT symbol, arg_max(close, ts) AS last_close FROM bars GROUP BY 1)
      SELECT symbol, epoch_us(ts) // 1000 AS ts_ms, coalesce(close, last_close) AS close FROM f JOIN z USING (symbol)""",
)
def _(v):
    hit = joins.asof(v.settlements.select("symbol", "ts"), v.bars, TS, ["close"], "forward")
    last = v.bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))
    return hit.join(last, "symbol").select(
        "symbol", ms("ts").alias("ts_ms"), F.coalesce("close", "last_close").alias("close")
    )


@query(
    "offset_join_with_coverage",
    "C8 B27",
    f"""WITH {BARS}, j AS (SELECT a.symbol, b.close AS later FROM bars a LEFT JOIN bars b
        ON a.symbol = b.symbol AND b.ts = a.ts + INTERVAL 5 HOUR)
      SELECT symbol, count(*) AS total, count(later) AS matched, round(count(later) / count(*), 6) + 0.0 AS coverage FROM j GROUP BY 1""",
)
def _(v):
    later = v.bars.select("symbol", "ts", F.col("close").alias("later"))
    out = joins.coverage(joins.at_offset(v.bars, later, ["symbol"], 5 * 3600, ["later"]), "later", ["symbol"])
    return rounded(out, "coverage")


@query(
    "interval_sum_funding",
    "C9",
    f"""WITH {BARS}, {SETTLEMENTS} SELECT b.symbol, epoch_ms(b.ts) AS ts_ms, round(coalesce(sum(s.rate), 0), 8) + 0.0 AS paid,
        count(s.rate) AS paid_n FROM bars b LEFT JOIN settlements s ON b.symbol = s.symbol AND s.ts > b.ts
        AND s.ts <= b.ts + INTERVAL 6 HOUR GROUP BY 1, 2""",
)
def _(v):
    ev = v.bars.select("symbol", "ts", F.col("ts").alias("event_ts"))
    out = joins.interval_sum(ev, v.settlements, TS, "rate", 6 * 3600, ["symbol", "event_ts"], "paid")
    return out.select("symbol", ms("event_ts").alias("ts_ms"), r("paid", 8).alias("paid"), "paid_n")


@query(
    "interval_containment_split",
    "C10",
    f"""WITH {BARS}, {SETTLEMENTS}, iv AS (SELECT symbol, ts AS a, ts + INTERVAL 90 MINUTE AS b FROM settlements WHERE rate > 0)
      SELECT symbol, epoch_ms(ts) AS ts_ms, EXISTS (SELECT 1 FROM iv WHERE iv.symbol = bars.symbol AND iv.a <= bars.ts AND bars.ts < iv.b) AS inside
      FROM bars""",
)
def _(v):
    iv = v.settlements.filter(F.col("rate") > 0).select(
        "symbol", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("b")
    )
    out = joins.inside_intervals(v.bars.select("symbol", "ts"), iv, TS, "a", "b", "inside")
    return out.select("symbol", ms("ts").alias("ts_ms"), "inside")


@query(
    "nearest_settlement_mask",
    "C11 B24",
    f"""WITH {BARS}, {SETTLEMENTS}, x AS (SELECT b.symbol, b.ts, s.ts AS back FROM bars b ASOF LEFT JOIN settlements s ON b.symbol = s.symbol AND b.ts >= s.ts),
      y AS (SELECT x.*, s.ts AS fwd FROM x ASOF LEFT JOIN settlements s ON x.symbol = s.symbol AND x.ts <= s.ts)
      SELECT symbol, epoch_ms(ts) AS ts_ms, least(epoch_ms(ts) - epoch_us(back) // 1000, epoch_us(fwd) // 1000 - epoch_ms(ts)) AS gap_ms,
        coalesce(least(epoch_ms(ts) - epoch_us(back) // 1000, epoch_us(fwd) // 1000 - epoch_ms(ts)) <= 3600000, false) AS near FROM y""",
)
def _(v):
    out = joins.nearest_gap(v.bars.select("symbol", "ts"), v.settlements, TS)
    near = F.coalesce(F.col("gap_ms") <= 3_600_000, F.lit(False))
    return out.select("symbol", ms("ts").alias("ts_ms"), "gap_ms", near.alias("near"))


@query(
    "day_regime_lookup_default",
    "C12 B19",
    f"""WITH {TRADES}, reg AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN avg(o_totalprice) > 252000 THEN 'bull_high_vol'
          WHEN avg(o_totalprice) < 248000 THEN 'bear_high_vol' WHEN avg(o_totalprice) > 250000 THEN 'sideways_high_vol' ELSE 'sideways' END AS regime FROM orders GROUP BY 1)
      SELECT coalesce(regime, 'out_of_window') AS regime, CASE WHEN regime LIKE 'b%' THEN split_part(regime, '_high', 1) ELSE coalesce(regime, 'out_of_window') END AS bucket,
        count(*) AS n, round(sum(profit_abs), 4) + 0.0 AS pnl FROM trades LEFT JOIN reg ON CAST(close_date AS DATE) = day GROUP BY 1, 2""",
)
def _(v):
    from tidegauge.functions.scalar import collapse_regime

    mean = F.avg("o_totalprice")
    reg = v.table("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.when(mean > 252000, "bull_high_vol").when(mean < 248000, "bear_high_vol").when(mean > 250000, "sideways_high_vol").otherwise("sideways").alias("regime")
    )
    t = v.trades.select(F.to_date("close_date").alias("day"), "profit_abs")
    out = joins.lookup(t, reg, ["day"], {"regime": "out_of_window"})
    return out.groupBy("regime", collapse_regime(F.col("regime")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("profit_abs"), 4).alias("pnl")
    )


@query(
    "anti_join_done_keys",
    "C15 A16",
    f"""WITH {BARS}, old AS (SELECT symbol, ts, close FROM bars WHERE volume < 200), new AS (SELECT symbol, ts, close + 1 AS close FROM bars WHERE close > 150)
      SELECT symbol, epoch_ms(ts) AS ts_ms, close FROM (SELECT * FROM old ANTI JOIN new USING (symbol, ts) UNION ALL SELECT * FROM new)""",
)
def _(v):
    from tidegauge.sources.sinks import upsert

    b = v.bars.select("symbol", "ts", "close", "volume")
    old = b.filter("volume < 200").drop("volume")
    new = b.filter("close > 150").select("symbol", "ts", (F.col("close") + 1).alias("close"))
    return upsert(old, new, ["symbol", "ts"]).select("symbol", ms("ts").alias("ts_ms"), "close")


@query(
    "bars_fold_range_join",
    "C19 J7 J8",
    f"""WITH {BARS}, e AS (SELECT min(ts) AS lo, max(ts) AS hi FROM bars),
      f AS (SELECT i AS fold, lo + i * INTERVAL 4 DAY AS tr0, lo + i * INTERVAL 4 DAY + INTERVAL 10 DAY AS tr1,
          lo + i * INTERVAL 4 DAY + INTERVAL 14 DAY AS te1 FROM e, range(0, 20) t(i) WHERE lo + i * INTERVAL 4 DAY + INTERVAL 14 DAY <= hi)
      SELECT fold, CASE WHEN ts < tr1 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(close), 6) + 0.0 AS mean_close
      FROM bars JOIN f ON ts >= tr0 AND ts < te1 GROUP BY 1, 2""",
)
def _(v):
    from tidegauge.plans.folds import assign, rolling_folds

    folds = rolling_folds(v.bars, "ts", train_days=10, validation_days=0, test_days=4, step_days=4)
    out = assign(v.bars, folds, "ts").filter(F.col("part").isin("train", "test"))
    return out.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), r(F.avg("close")).alias("mean_close"))


@query(
    "fold_overlap_gaps",
    "E39 J8",
    f"""WITH {BARS}, e AS (SELECT min(ts) AS lo, max(ts) AS hi FROM bars),
      f AS (SELECT i AS fold, lo + i * INTERVAL 4 DAY AS tr0, lo + i * INTERVAL 4 DAY + INTERVAL 14 DAY AS te1 FROM e, range(0, 20) t(i)
        WHERE lo + i * INTERVAL 4 DAY + INTERVAL 14 DAY <= hi)
      SELECT fold, CAST(date_diff('day', lag(te1) OVER (ORDER BY fold), tr0) AS BIGINT) AS gap_days,
        coalesce(date_diff('day', lag(te1) OVER (ORDER BY fold), tr0) < 0, false) AS overlaps FROM f""",
)
def _(v):
    from tidegauge.plans.folds import overlap_report, rolling_folds

    folds = rolling_folds(v.bars, "ts", train_days=10, validation_days=0, test_days=4, step_days=4)
    return overlap_report(folds)


@query(
    "trade_overlap_and_duplicates",
    "C24",
    f"""WITH {TRADES}, t AS (SELECT pair, open_date, close_date, count(*) AS copies FROM trades GROUP BY ALL),
      x AS (SELECT *, max(close_date) OVER (PARTITION BY pair ORDER BY open_date, close_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t)
      SELECT pair, CAST(sum(copies) AS BIGINT) AS n, CAST(sum(CASE WHEN reach > open_date THEN 1 ELSE 0 END) AS BIGINT) AS overlapping,
        CAST(sum(CASE WHEN copies > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated FROM x GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.ledger import overlap_trace

    return overlap_trace(v.trades, span=30 * 86_400)


@query(
    "max_concurrent_trades",
    "E38",
    f"""WITH {TRADES}, p AS (SELECT pair, open_date AS t, 1 AS o, 1 AS d FROM trades UNION ALL SELECT pair, close_date, 0, -1 FROM trades),
      g AS (SELECT pair, t, o, sum(d) AS d FROM p GROUP BY ALL),
      x AS (SELECT pair, sum(d) OVER (PARTITION BY pair ORDER BY t, o) AS level FROM g)
      SELECT pair, CAST(max(level) AS BIGINT) AS max_open FROM x GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.positions import max_concurrent

    return max_concurrent(v.trades, Series(("pair",), "ts", (), span=30 * 86_400), "open_date", "close_date")


@query(
    "event_study_first_price",
    "K5 C6",
    f"""WITH {TICKS}, e AS (SELECT symbol, ts, agg_id FROM ticks WHERE event_type = 'purchase'),
      b AS (SELECT e.*, t.price AS p0 FROM e ASOF LEFT JOIN ticks t ON e.symbol = t.symbol AND e.ts <= t.ts),
      h AS (SELECT *, unnest([3600, 14400]) AS h FROM b), l AS (SELECT *, ts + to_seconds(h) AS t1 FROM h)
      SELECT l.agg_id, l.h, round(t.price / l.p0 - 1, 6) + 0.0 AS ret FROM l ASOF LEFT JOIN ticks t ON l.symbol = t.symbol AND l.t1 <= t.ts""",
)
def _(v):
    ev = v.ticks.filter(F.col("event_type") == "purchase").select("symbol", "ts", F.col("agg_id").alias("event_id"))
    out = events.study(ev, v.ticks.select("symbol", "ts", "price"), TS, (3600, 14400), "event_id")
    return out.select(F.col("event_id").alias("agg_id"), "h", r("ret").alias("ret"))


@query(
    "required_price_lookup",
    "C3 C27",
    f"""WITH {BARS}, e AS (SELECT symbol, ts, ts + INTERVAL 6 HOUR AS x FROM bars),
      j AS (SELECT e.*, a.close AS p0, b.close AS p1 FROM e JOIN bars a ON a.symbol = e.symbol AND a.ts = e.ts LEFT JOIN bars b ON b.symbol = e.symbol AND b.ts = e.x)
      SELECT symbol, count(*) AS entries, CAST(count(*) - count(p1) AS BIGINT) AS unmatched, round(avg(p1 / p0 - 1), 6) + 0.0 AS mean_ret FROM j GROUP BY 1""",
)
def _(v):
    entries = v.bars.select("symbol", "ts", F.col("close").alias("p0"))
    entries = joins.require_complete(entries, ["p0"], "entry price")
    out = joins.at_offset(entries, v.bars.select("symbol", "ts", F.col("close").alias("p1")), ["symbol"], 6 * 3600, ["p1"])
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("p1").isNull()).alias("unmatched"),
        r(F.avg(F.col("p1") / F.col("p0") - 1)).alias("mean_ret"),
    )


@query(
    "universe_with_open_counts",
    "C25 D11",
    f"""WITH {TRADES}, o AS (SELECT pair, count(*) AS n_open FROM trades WHERE status = 'O' GROUP BY 1),
      u AS (SELECT DISTINCT l_returnflag || l_linestatus AS name, l_returnflag AS pair FROM lineitem)
      SELECT name, pair, coalesce(n_open, 0) AS n_open FROM u LEFT JOIN o USING (pair)""",
)
def _(v):
    u = v.table("lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_returnflag").alias("pair")
    )
    n = v.trades.filter("status = 'O'").groupBy("pair").agg(F.count(F.lit(1)).alias("n_open"))
    return joins.lookup(u.distinct(), n, ["pair"], {"n_open": 0})


@query(
    "nearest_by_value_benchmark",
    "C26 C28",
    f"""WITH {TRADES}, a AS (SELECT pair, avg(date_diff('day', open_date, close_date)) AS expo, avg(profit_ratio) AS net FROM trades GROUP BY 1),
      b AS (SELECT l_shipdate_year AS bench, avg(expo) AS expo, avg(net) AS net FROM (SELECT year(close_date) AS l_shipdate_year,
          date_diff('day', open_date, close_date) AS expo, profit_ratio AS net FROM trades) GROUP BY 1
        UNION ALL SELECT 3000, max(expo), max_by(net, expo) FROM a)
      SELECT pair, arg_min(bench, round(abs(a.expo - b.expo), 9)) AS nearest, bool_or(b.expo <= a.expo + 1e-9 AND b.net >= a.net - 1e-9 AND NOT (abs(b.expo - a.expo) < 1e-9 AND abs(b.net - a.net) < 1e-9)) AS dominated
      FROM a CROSS JOIN b GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.gates import dominance, nearest_benchmark

    # trades are read once: sums by pair and year are stored, runs and benchmarks are told from them
    t = v.trades.withColumn("expo", F.datediff("close_date", "open_date"))
    parts = [f(F.col(c)).alias(f"{n}_{c}") for c in ("expo", "profit_ratio") for n, f in (("sum", F.sum), ("n", F.count))]
    t = materialise(t.groupBy("pair", F.year("close_date").cast("long").alias("bench")).agg(*parts), "sums")
    means = [F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}")).alias(out) for c, out in (("expo", "expo"), ("profit_ratio", "net"))]
    a, b = materialise(t.groupBy("pair").agg(*means), "runs"), t.groupBy("bench").agg(*means)
    # one benchmark is identical to a run, which it must not dominate
    b = b.unionByName(a.agg(F.lit(3000).cast("long").alias("bench"), F.max("expo").alias("expo"), F.max_by("net", "expo").alias("net")))
    return nearest_benchmark(a, b, "pair", "bench", "expo").join(dominance(a, b, "pair", "expo", "net"), "pair")


@query(
    "union_and_distinct_times",
    "G1 G3",
    f"""WITH {BARS}, {SETTLEMENTS} SELECT epoch_us(ts) // 1000 AS ts_ms FROM (SELECT ts FROM bars UNION SELECT ts FROM settlements)""",
)
def _(v):
    both = v.bars.select("ts").unionByName(v.settlements.select("ts"))
    return both.distinct().select(ms("ts").alias("ts_ms"))


@query(
    "entry_time_not_in_bars",
    "G2 G4",
    f"""WITH {BARS} SELECT symbol, epoch_ms(ts) AS ts_ms FROM (SELECT symbol, ts + INTERVAL 1 HOUR AS ts FROM bars EXCEPT SELECT symbol, ts FROM bars)""",
)
def _(v):
    entries = v.bars.select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return entries.exceptAll(v.bars.select("symbol", "ts")).select("symbol", ms("ts").alias("ts_ms"))
