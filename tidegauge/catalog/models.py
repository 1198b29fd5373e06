"""Scaling, models and arms: J1-J10, K10."""

from pyspark.sql import functions as F

from tidegauge.catalog.base import BARS, ms, query, r, rounded
from tidegauge.operators import arms, bars
from tidegauge.operators import models as M
from tidegauge.operators import windows as w
from tidegauge.operators.features import BLOCK_COLUMNS, bar_features, cross_asset, mean_pairwise_corr, ratio_change
from tidegauge.plans.folds import calendar_folds
from tidegauge.plans.series import framed
from tidegauge.plans.stage import materialise
from tidegauge.sources.views import BAR_SERIES

FEATURES = ("ret_1", "ret_3", "sma_ratio", "range_pct")
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def _frame(v):
    c = F.col("close")

    def build(d, b):
        return d.withColumns(
            {
                "ret_1": w.change(b, c, 1),
                "ret_3": w.change(b, c, 3),
                "sma_ratio": w.ratio(c, w.sma(b, c, 12)) - 1,
                "range_pct": (F.col("high") - F.col("low")) / c,
                "l2": w.forward_return(b, c, 4),
            }
        )

    d = framed(v.bars, BAR_SERIES, build, back=12, ahead=4).na.drop(subset=[*FEATURES, "l2"])
    key = F.unix_micros("ts") * 10 + F.substring("symbol", 2, 1).cast("long")
    return d.withColumns({"l0": (F.col("l2") > 0).cast("double"), "id": key})


@query(
    "train_only_normaliser",
    "J1 J2",
    f"""WITH {BARS}, p AS (SELECT avg(close) AS m, stddev_pop(close) AS s, avg(volume) AS mv, stddev_pop(volume) AS sv FROM bars WHERE ts < TIMESTAMP '2024-01-15')
      SELECT symbol, epoch_ms(ts) AS ts_ms, round((close - m) / s, 6) + 0.0 AS close, round((volume - mv) / sv, 6) + 0.0 AS volume FROM bars, p WHERE ts >= TIMESTAMP '2024-01-15'""",
)
def _(v):
    cut = F.lit("2024-01-15").cast("timestamp")
    fitted = M.fit_normaliser(v.bars.filter(F.col("ts") < cut), ["close", "volume"])
    out = M.normalise(v.bars.filter(F.col("ts") >= cut), fitted, ["close", "volume"])
    return rounded(out.select("symbol", ms("ts").alias("ts_ms"), "close", "volume"), "close", "volume")


@query(
    "base_rate_scorer",
    "J6 J7 J10",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, lead(close, 4) OVER w / close - 1 AS f FROM nb {W}), y AS (SELECT *, CAST(f > 0 AS INTEGER) AS l FROM x WHERE f IS NOT NULL)
      SELECT symbol, count(*) AS n, round(max(p), 6) + 0.0 AS score FROM y, (SELECT avg(l) AS p FROM y WHERE ts < TIMESTAMP '2024-01-15') WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1""",
)
def _(v):
    from tidegauge.operators.features import labels

    d = labels(v.bars, BAR_SERIES, 4, 0.003).na.drop(subset=["l2"])
    cut = F.lit("2024-01-15").cast("timestamp")
    out = M.base_rate(d.filter(F.col("ts") < cut), d.filter(F.col("ts") >= cut), "l0")
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.max("score")).alias("score"))


@query(
    "expanding_calendar_folds",
    "J7 J8",
    f"""WITH {BARS}, e AS (SELECT epoch_ms(min(ts)) // 1000 AS lo, epoch_ms(max(ts)) // 1000 AS hi FROM bars), f AS (SELECT lo, hi, lo + CAST(floor((hi - lo) * 0.5) AS BIGINT) AS first FROM e),
      g AS (SELECT *, (hi - first) // 5 AS w FROM f) SELECT i AS fold, lo * 1000 AS a, (first + i * w) * 1000 AS b, (first + (i + 1) * w) * 1000 AS c FROM g, range(0, 5) t(i)""",
)
def _(v):
    from tidegauge.plans.folds import bounds_broken

    f = calendar_folds(v.bars, "ts", 5)
    assert set(bounds_broken(f).columns) == set(f.columns)
    return f.select("fold", ms("train_start").alias("a"), ms("train_end").alias("b"), ms("test_end").alias("c"))


@query("walk_forward_model_consistency", "J2 J3 J4 J5 J9 K10")
def _(v):
    d = materialise(_frame(v), "frame")
    s = M.walk_forward(d, calendar_folds(d, "ts", 2), FEATURES, "l0", ["M0", "M1", "M2", "M3"], trees=20, depth=4, rounds=5)
    return rounded(M.consistency(s, 0.003), "positive_share", "mean_pss")


@query("regression_arm_scores", "J3 J4 K10")
def _(v):
    from tidegauge.operators.scoring import regression_losses

    d = materialise(_frame(v), "frame")
    cut = F.lit("2024-01-15").cast("timestamp")
    train, test = d.filter(F.col("ts") < cut), d.filter(F.col("ts") >= cut)
    parts = [M.fit_score(train, test, FEATURES, "l2", m, classify=False, trees=20, depth=4).withColumn("model", F.lit(m)) for m in ("M1", "M2")]
    both = parts[0].unionByName(parts[1])
    return rounded(both.groupBy("model").agg(*regression_losses(F.col("score"), F.col("l2"))), "rmse", "r2")


BASE28 = BLOCK_COLUMNS["B3"]
CONTEXT = ("breadth_1", "breadth_12", "dispersion_12", "base_rel_12", "ratio_chg_12", "mean_corr")
COST = 0.003


def _context(v, members):
    """What the other assets did, per instant, from hourly closes carried over gaps: S0 is the base, S1 over S0 the ratio."""
    hourly = bars.filled(v.bars.select("symbol", "ts", "close"), 3600, ["close"], [], BAR_SERIES).select("symbol", "ts", "close")
    wide = cross_asset(hourly, BAR_SERIES, base="S0", universe=members)
    ratio = ratio_change(hourly, BAR_SERIES, "S1", "S0", 12).select("ts", "ratio_chg_12")
    corr = mean_pairwise_corr(hourly, BAR_SERIES, 3600, 48, universe=["S0", *members])
    return wide.join(ratio, "ts").join(corr, "ts").select("ts", *CONTEXT)


def _arm_rows(v):
    """All 28 bar features of all symbols, and the label: does the return of four bars beat the cost."""
    d = bar_features(v.bars, BAR_SERIES, per_year=24 * 365, rank_window=48)
    d = framed(d, BAR_SERIES, lambda d, b: d.withColumn("l2", w.forward_return(b, F.col("close"), 4)), ahead=4)
    key = F.unix_micros("ts") * 10 + F.substring("symbol", 2, 1).cast("long")
    return materialise(d.na.drop(subset=[*BASE28, "l2"]).withColumns({"l1": (F.col("l2") > COST).cast("double"), "id": key}), "arm-rows")


def _members(v):
    return [x[0] for x in v.bars.select("symbol").filter("symbol <> 'S0'").distinct().orderBy("symbol").collect()]


def _split(d):
    cut = F.lit("2024-01-20").cast("timestamp")
    return d.filter(F.col("ts") < cut), d.filter(F.col("ts") >= cut)


@query("incremental_arms_base_new_full", "K10 I17 J4")
def _(v):
    d = materialise(_arm_rows(v).join(_context(v, _members(v)), "ts"), "arm-frame")
    train, test = _split(d)
    out = arms.incremental(train, test, BASE28, CONTEXT, "l1", "l2", "id", COST)
    cols = ("least", "most", "pss", "edge_over_cost", "t_stat", "p", "q", "cohens_d", "delta_mean", "delta_lo", "delta_hi")
    return rounded(out.select("arm", "n_features", "n_test", "n_top", *cols, "passed"), *cols)


@query("incremental_arms_leave_one_out_model", "K10 J4")
def _(v):
    """FULL without each asset but the base and the one of the ratio, as published; the assets are those of the data."""
    rows, members = _arm_rows(v), _members(v)

    def features(stay):
        return _split(materialise(rows.join(_context(v, ["S1", *stay]), "ts"), "arm-frame"))

    out = arms.leave_one_out([m for m in members if m != "S1"], features, BASE28, CONTEXT, "l1", "l2", "id", COST)
    cols = ("least", "most", "pss", "edge_over_cost", "t_stat", "p")
    return rounded(out.select("left_out", "n_features", "n_test", "n_top", *cols), *cols)
