"""Feature tables: bar features, context features and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import bars as B
from tidegauge.operators import joins, windows as w
from tidegauge.operators.order_stats import mean_pair_correlation
from tidegauge.plans.single import attach
from tidegauge.plans.series import Blocks, Series, block_size, ewm, framed, memory, rma


# fixed values: feature names per block, in output order
RETURNS = (1, 3, 12, 36, 72)
BLOCK_COLUMNS = {
    "B0": (
        "ret_1", "ret_3", "ret_12", "ret_36", "ret_72", "sma50_ratio", "sma200_ratio", "ema12_ratio", "ema26_ratio",
        "sma_trend", "sma50_slope", "vol_z", "vol_change", "vol_ratio_168",
    ),
    "B1": ("rsi14", "roc_36", "ema_diff_12_26", "atr14_ratio", "roll_std_24_ratio", "rv_12", "vol_percentile_1d"),
    "B2": ("body_ratio", "up_wick_ratio", "low_wick_ratio", "close_pos", "range_pct", "adx14_ratio", "vol_rank_288"),
}
BLOCK_COLUMNS["B3"] = BLOCK_COLUMNS["B0"] + BLOCK_COLUMNS["B1"] + BLOCK_COLUMNS["B2"]
WILDER = 13 / 14
EMA_FAST, EMA_SLOW = 11 / 13, 25 / 27


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    lacking = sorted(set(needed) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def labels(df: DataFrame, s: Series, horizon: int, cost: float) -> DataFrame:
    """Forward return l2, its sign l0 and cost-beating flag l1; null on the tail."""
    out = framed(df, s, lambda d, b: d.withColumn("l2", w.forward_return(b, F.col("close"), horizon)), ahead=horizon)
    return out.withColumns({"l0": (F.col("l2") > 0).cast("int"), "l1": (F.col("l2") > cost).cast("int")})


def bar_features(
    df: DataFrame, s: Series, per_year: float = 288 * 365, rank_window: int = 288, blocks: Sequence[str] = ("B3",)
) -> DataFrame:
    """The 28 causal bar features, in one numbering pass and one windowed shuffle."""
    require_columns(df, ("open", "high", "low", "close", "volume"))
    o, h, low, v = F.col("open"), F.col("high"), F.col("low"), F.col("volume")
    history = memory(WILDER)
    back = max(2 * history, history + rank_window, memory(EMA_SLOW), 24 + rank_window, 212)

    def build(d: DataFrame, b: Blocks) -> DataFrame:
        prev = F.lag("close").over(b.w)
        diff = F.col("close") - prev
        up, down = h - F.lag("high").over(b.w), F.lag("low").over(b.w) - low
        d = d.withColumns(
            {
                **{f"ret_{k}": w.change(b, F.col("close"), k) for k in RETURNS},
                "__s50": w.sma(b, F.col("close"), 50),
                "__s200": w.sma(b, F.col("close"), 200),
                "__sd24": w.rolling_std(b, F.col("close"), 24),
                "__v24": w.sma(b, v, 24),
                "__v168": w.sma(b, v, 168),
                "vol_change": w.change(b, v, 1),
                "__gain": F.greatest(diff, F.lit(0.0)) + F.lit(0.0) * diff,
                "__loss": F.greatest(-diff, F.lit(0.0)) + F.lit(0.0) * diff,
                "__tr": w.true_range(b, h, low, F.col("close")),
                "__pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
                "__mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
            }
        )
        d = d.withColumns(
            {
                "__e12": ewm(b, F.col("close"), EMA_FAST),
                "__e26": ewm(b, F.col("close"), EMA_SLOW),
                "__ag": ewm(b, F.col("__gain"), WILDER, first=1, min_rows=14),
                "__al": ewm(b, F.col("__loss"), WILDER, first=1, min_rows=14),
                "__atr": ewm(b, F.col("__tr"), WILDER, first=0, min_rows=14),
                "__str": rma(b, F.col("__tr"), 14),
                "__sp": rma(b, F.col("__pdm"), 14),
                "__sm": rma(b, F.col("__mdm"), 14),
                "rv_12": w.realised_vol(b, F.col("ret_1"), 12, per_year),
                "vol_percentile_1d": w.share_at_or_below(b, F.col("__sd24"), rank_window),
                "sma50_slope": w.change(b, F.col("__s50"), 12),
            }
        )
        pdi, mdi = w.ratio(F.col("__sp"), F.col("__str")), w.ratio(F.col("__sm"), F.col("__str"))
        d = d.withColumn("__dx", w.ratio(100 * F.abs(pdi - mdi), pdi + mdi))
        d = d.withColumns(
            {
                "adx14_ratio": rma(b, F.col("__dx"), 14, first=13) / 100,
                "vol_rank_288": w.share_at_or_below(b, F.col("__atr"), rank_window),
            }
        )
        return d.withColumns(
            {
                "sma50_ratio": w.ratio(F.col("close"), F.col("__s50")) - 1,
                "sma200_ratio": w.ratio(F.col("close"), F.col("__s200")) - 1,
                "ema12_ratio": w.ratio(F.col("close"), F.col("__e12")) - 1,
                "ema26_ratio": w.ratio(F.col("close"), F.col("__e26")) - 1,
                "sma_trend": (F.col("__s50") > F.col("__s200")).cast("double"),
                "vol_z": w.ratio(v, F.col("__v24")) - 1,
                "vol_ratio_168": w.ratio(v, F.col("__v168")) - 1,
                "rsi14": rsi_value(F.col("__ag"), F.col("__al")),
                "roc_36": F.col("ret_36"),
                "ema_diff_12_26": w.ratio(F.col("__e12") - F.col("__e26"), F.col("close")),
                "atr14_ratio": w.ratio(F.col("__atr"), F.col("close")),
                "roll_std_24_ratio": w.ratio(F.col("__sd24"), F.col("close")),
                **w.candle_shape(o, h, low, F.col("close")),
            }
        )

    size = block_size([WILDER, EMA_FAST, EMA_SLOW], back)
    cols = list(dict.fromkeys(c for name in blocks for c in BLOCK_COLUMNS[name]))
    return framed(df, s, build, back=back, size=size).select(*df.columns, *cols)


def rsi_value(gain, loss):
    """100 - 100/(1+gain/loss); all-gain gives 100, no movement gives null."""
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when((loss == 0) & (gain > 0), F.lit(100.0))


def funding_features(bars: DataFrame, settlements: DataFrame, s: Series, window: int = 30, cap: int = 8) -> DataFrame:
    """Settlement-indexed features made visible to bars from their instant on."""
    x = F.col("rate")

    def build(d: DataFrame, b: Blocks) -> DataFrame:
        return d.withColumns(
            {
                "fund_rate": x,
                "fund_z": w.zscore(b, x, window),
                "fund_sign": F.signum(x),
                "fund_abs_chg": F.abs(x - F.lag(x).over(b.w)),
                "fund_persist": w.sign_run(b, x, cap),
            }
        )

    per = framed(settlements, s, build, back=max(window, cap))
    cols = ["fund_rate", "fund_z", "fund_sign", "fund_abs_chg", "fund_persist"]
    return joins.asof(bars, per, s, cols)


def open_interest_features(bars: DataFrame, snapshots: DataFrame, s: Series, window: int = 288) -> DataFrame:
    grid = joins.asof(bars, snapshots, s, ["oi"])
    oi = F.col("oi")

    def build(d: DataFrame, b: Blocks) -> DataFrame:
        d = d.withColumns({"oi_chg_12": w.positive_change(b, oi, 12), "oi_chg_1": w.positive_change(b, oi, 1)})
        return d.withColumns(
            {
                "oi_z": w.zscore(b, oi, window),
                "oi_price_div": w.sign_divergence(w.positive_change(b, F.col("close"), 12), F.col("oi_chg_12")),
                "oi_range": w.range_position(b, oi, window),
            }
        )

    return framed(grid, s, build, back=window)


def cross_asset(bars: DataFrame, s: Series, base: str, universe: Sequence[str]) -> DataFrame:
    """Breadth, dispersion and base-relative return over a universe, per instant.

    A figure is null unless every asset of the universe has its return.
    """
    ret = framed(
        bars.select("symbol", "ts", "close"),
        s,
        lambda d, b: d.withColumns({"r1": w.positive_change(b, F.col("close"), 1), "r12": w.positive_change(b, F.col("close"), 12)}),
        back=12,
    )
    inside = F.col("symbol").isin(list(universe))
    own = F.col("symbol") == base
    n = len(universe)
    agg = ret.filter(inside | own).groupBy("ts").agg(
        F.count(F.when(inside, F.col("r1"))).alias("__n1"),
        F.count(F.when(inside, F.col("r12"))).alias("__n12"),
        F.count(F.when(inside, F.lit(1))).alias("__rows"),
        F.avg(F.when(inside, (F.col("r1") > 0).cast("double"))).alias("b1"),
        F.avg(F.when(inside, (F.col("r12") > 0).cast("double"))).alias("b12"),
        F.stddev_samp(F.when(inside, F.col("r12"))).alias("sd"),
        F.avg(F.when(inside, F.col("r12"))).alias("m12"),
        F.max(F.when(own, F.col("r12"))).alias("base"),
    )
    full1, full12 = F.col("__n1") == n, F.col("__n12") == n
    return agg.filter(F.col("__rows") > 0).select(
        "ts",
        F.when(full1, F.col("b1")).alias("breadth_1"),
        F.when(full12, F.col("b12")).alias("breadth_12"),
        F.when(full12, F.col("sd")).alias("dispersion_12"),
        F.when(full12, F.col("base") - F.col("m12")).alias("base_rel_12"),
    )


def ratio_change(bars: DataFrame, s: Series, top: str, bottom: str, k: int) -> DataFrame:
    """k-row change of the price ratio of two assets on their common instants."""
    both = (
        bars.filter(F.col("symbol").isin(top, bottom))
        .groupBy("ts")
        .agg(
            F.max(F.when(F.col("symbol") == top, F.col("close"))).alias("a"),
            F.max(F.when(F.col("symbol") == bottom, F.col("close"))).alias("b"),
        )
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.lit(f"{top}/{bottom}").alias("symbol"), "ts", (F.col("a") / F.col("b")).alias("q"))
    )
    name = f"ratio_chg_{k}"
    return framed(both, s, lambda d, b: d.withColumn(name, w.positive_change(b, F.col("q"), k)), back=k)


def mean_pairwise_corr(bars: DataFrame, s: Series, step: int, n: int = 288, universe: Sequence[str] | None = None) -> DataFrame:
    """Mean Pearson correlation over all pairs of symbols in an N-row grid window.

    Without ``universe`` the symbols are those of the data, found once.  Each instant is one row with a vector of
    returns; windows sum the products of all pairs, so the plan is the same for any number of symbols.  A
    missing return of any symbol inside the window gives no result.
    """
    if universe is None:
        names = bars.agg(F.array_sort(F.collect_set("symbol")).alias("__names"))  # one row: the symbols there are
    else:
        names = bars.sparkSession.range(1).select(F.array(*[F.lit(u) for u in universe]).alias("__names"))
    closes = bars.filter(F.col("symbol").isNotNull()).groupBy("ts", "symbol").agg(F.max("close").alias("c"))
    closes = closes.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "c"))).alias("__at")).withColumn("panel", F.lit("all"))
    grid = attach(B.spine(closes, step, ("panel",)).join(closes, ["panel", "ts"], "left"), names)
    grid = grid.withColumn("__c", F.transform("__names", lambda u: F.try_element_at("__at", u))).drop("__at", "__names")
    one = Series(("panel",), s.ts, (), s.span)

    def returns(d: DataFrame, b: Blocks) -> DataFrame:
        change = F.zip_with("__c", F.lag("__c").over(b.w), lambda now, was: F.when((now > 0) & (was > 0), now / was - 1))
        return d.withColumn("__r", change)

    out = mean_pair_correlation(framed(grid, one, returns, back=1).drop("__c").filter(F.col("__r").isNotNull()), one, "__r", n)
    return out.filter(F.col("mean_corr").isNotNull()).select("ts", "mean_corr")
