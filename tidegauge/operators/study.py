"""Composite studies: cell bundles, calendar rules, walk-forward ledgers, variant grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import tails
from tidegauge.operators import gates, ledger, scoring, stats, windows as w
from tidegauge.operators.positions import hold_state
from tidegauge.plans.ranking import exact_rank
from tidegauge.plans.series import Series, framed
from tidegauge.plans.stage import materialise


def cell_bundle(scores: DataFrame, cell: list[str], cost: float) -> DataFrame:
    """Every metric of every cell: premium, tests, areas, losses, calibration, order.

    Scores feed two orders: all rows by (score, id), stored for premium, calibration and deciles, and distinct scores
    for areas and rank correlation.  So scores are stored once.  So is the bundle, one row per cell: the ranks of its
    p-values read it many times, and all must see the same numbers.
    """
    s = materialise(scores.select(*cell, "id", "score", "fwd", "label"), "scores")
    ranked = materialise(exact_rank(s, cell, "score", "id").drop("id"), "ranked")
    top = scoring.top_premium_of_ranked(ranked, cell, "score", "fwd", cost)
    top = top.withColumns(
        {
            "p_test": tails.t_greater("t_stat", F.col("n_top") - 1),
            "power": tails.power_two_sample("cohens_d", F.least("n_top", "n_bot").cast("double")),
        }
    )
    losses = s.groupBy(*cell).agg(*scoring.probability_losses(F.col("score"), F.col("label")), F.count(F.lit(1)).alias("n_val"))
    areas = scoring.areas_and_rank_correlation(s, cell, "score", "fwd", "label")
    ece = scoring.chunked_gap(ranked, cell, "score", "label")
    bucket = scoring.decile_of(F.col("rn"), F.col("n")).alias("bucket")
    dec = ranked.groupBy(*cell, bucket).agg(F.avg("fwd").alias("mean"))
    tau = scoring.kendall_over_buckets(dec, cell, "bucket", "mean")
    out = losses
    for part in (top, areas, ece, tau):
        out = out.join(part, cell)
    return materialise(out, "bundle")


def judged(cells: DataFrame, family: list[str], tie: str) -> DataFrame:
    """Cells with BH q-values in their family."""
    return stats.bh_adjust(cells, family, "p_test", tie)


def matrix_verdict(bundle: DataFrame, family: str, cell: str, block: Column, model: Column) -> DataFrame:
    """Family verdicts over the cell matrix."""
    q = judged(bundle, [family], cell)
    named = q.withColumns({"cell_id": F.col(cell).cast("string"), "cell_rank": F.col(cell), "block": block, "model": model})
    return gates.arm_gate(named, family)


def calendar_rule_table(events: DataFrame, by: list[str], years: float) -> DataFrame:
    """n, net, theta, t, effect and win rate of rule events per group."""
    theta = stats.event_theta(events, by, "net", years)
    t = stats.one_sample_t(events, by, F.col("net"))
    return theta.join(t.select(*by, "t", "d", "p"), by)


def walk_forward_report(trades: DataFrame, folds: DataFrame, regime: DataFrame, start: float) -> DataFrame:
    """Per fold and regime (and per fold over all regimes): ledger metrics of the test window."""
    from tidegauge.operators.joins import lookup
    from tidegauge.plans.folds import assign

    t = assign(trades, folds, "close_date", only="test")
    t = lookup(t.withColumn("day", F.to_date("close_date")), regime, ["day"], {"regime": "out_of_window"})
    parts = t.rollup("fold", "regime").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("profit_abs").alias("net"),
        ledger.win_rate("profit_abs").alias("win_rate"),
        ledger.profit_factor("profit_abs").alias("profit_factor"),
    )
    daily = t.groupBy("fold", F.to_date("close_date").alias("day")).agg(F.sum("profit_ratio").alias("r"))
    ratio = daily.groupBy("fold").agg(ledger.returns_stats("r", 365)[0])
    named = parts.filter(F.col("fold").isNotNull()).withColumn("regime", F.coalesce("regime", F.lit("all")))
    return named.join(ratio, "fold")


def channel_variants(bars: DataFrame, s: Series, lengths: Sequence[int], costs: Sequence[float]) -> DataFrame:
    """Monthly result of channel rules over lengths and costs.

    All lengths share one windowed pass; costs only change the arithmetic.
    """
    c = F.col("close")

    def build(d, b):
        cols = {}
        for n in lengths:
            up, dn = w.donchian(b, F.col("high"), F.col("low"), n)
            cols[f"__f{n}"] = F.when(c >= up, 1).when(c <= dn, 0)
        return d.withColumns({**cols, "ret": w.forward_return(b, c, 1)})

    wide = framed(bars, s, build, back=max(lengths), ahead=1)
    long = wide.select(
        *s.keys, s.ts, "ret",
        F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.col(f"__f{n}").alias("flip")) for n in lengths])).alias("z"),
    ).select(*s.keys, s.ts, "ret", "z.length", "z.flip")
    v = Series((*s.keys, "length"), s.ts, s.ties, s.span)
    held = hold_state(materialise(long, "flips"), v, "flip", "in_market")
    held = framed(held, v, lambda d, b: d.withColumn("turn", F.abs(F.col("in_market") - F.coalesce(F.lag("in_market").over(b.w), F.lit(0)))), back=1)
    priced = held.withColumn("cost", F.explode(F.array(*[F.lit(x) for x in costs])))
    net = F.col("in_market") * F.coalesce("ret", F.lit(0.0)) - F.col("turn") * F.col("cost")
    monthly = priced.groupBy(*s.keys, "length", "cost", F.date_trunc("month", s.ts).alias("period")).agg(F.sum(net).alias("net"))
    return monthly.groupBy("length", "cost").agg(
        F.count(F.lit(1)).alias("periods"), F.count_if(F.col("net") > 0).alias("positive"), F.avg("net").alias("mean_net")
    )
