"""Scores against outcomes: deciles, premiums, calibration, rank statistics.

Ranks come from plans.ranking, so one big cell spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.plans.ranking import exact_quantiles, exact_rank, sent, value_ranks
from tidegauge.plans.single import attach
from tidegauge.plans.stage import materialise

NEAR = 0.001  # share of a cell's rows on either side of a border that are ordered


def tail_profile(df: DataFrame, by: list[str], ret: str, thr: float) -> DataFrame:
    """Mean, median and tail probabilities of a return column."""
    x = F.col(ret)
    agg = df.groupBy(*by).agg(
        F.avg((x > 0).cast("double")).alias("p_pos"),
        F.avg((x > thr).cast("double")).alias("p_over"),
        F.avg((x < -thr).cast("double")).alias("p_under"),
        F.avg(F.when(x > 0, x)).alias("mean_if_pos"),
        F.avg(x).alias("mean"),
    )
    return agg.join(exact_quantiles(df, by, ret, {"median": 0.5}), by)


def decile_of(rn: Column, n: Column, buckets: int = 10) -> Column:
    """Integer-boundary bucket: row rn (1-based, ascending) goes to ceil(k*rn/n) - 1."""
    return (F.ceil(rn * buckets / n) - 1).cast("long")


def with_decile(df: DataFrame, cell: list[str], score: str, tie: str, buckets: int = 10) -> DataFrame:
    ranked = exact_rank(df, cell, score, tie)
    return ranked.withColumn("bucket", decile_of(F.col("rn"), F.col("n"), buckets))


def decile_table(df: DataFrame, cell: list[str], score: str, ret: str, tie: str, cost: float, buckets: int = 10) -> DataFrame:
    """Outcome profile per score bucket, top bucket last.

    The bucketed rows feed a profile and an exact median, so they are stored.
    """
    b = materialise(with_decile(df.select(*cell, score, ret, tie), cell, score, tie, buckets), "deciles")
    x = F.col(ret)
    prof = b.groupBy(*cell, "bucket").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(x).alias("mean"),
        F.avg((x > 0).cast("double")).alias("p_gt_0"),
        F.avg((x > cost).cast("double")).alias("p_gt_cost"),
    )
    med = exact_quantiles(b, [*cell, "bucket"], ret, {"median": 0.5})
    net = F.col("mean") - cost
    return prof.join(med, [*cell, "bucket"]).withColumns({"net": net, "edge_over_cost": net / cost})


def top_premium(df: DataFrame, cell: list[str], score: str, ret: str, tie: str, cost: float, share: float = 0.10) -> DataFrame:
    """Premium of the top share over cost with the moments its tests need.

    Top and bottom hold ceil(share * n) rows; ties go to the lower tie column.
    """
    d = df.select(*cell, score, ret, tie).withColumn("__neg", -F.col(score))
    sure, near = _ends(d, cell, "__neg", tie, share)
    top, bot = F.col("__first"), F.col("__last")
    cols = [*cell, ret, "__first", "__last"]
    return _premium(sure.select(cols).unionByName(near.select(cols)).filter(top | bot), cell, top, bot, ret, cost)


def _ends(df: DataFrame, cell: list[str], score: str, tie: str, share: float) -> tuple[DataFrame, DataFrame]:
    """Rows told to be among the first and the last ceil(share * n) of their cell by ascending (score, tie).

    Approximate quantiles around both borders cut a cell into five zones, whose exact counts tell both for all rows but
    those of the zones that hold a border (second table).  Only these are ordered, so most rows are neither shuffled
    nor sorted.  However far the quantiles are off, or many scores equal, the result is exact: the zone is only larger.
    """
    s, key = F.col(score), [*cell, "__zone"]
    d = df.filter(s.isNotNull())
    at = sorted((min(1.0, max(0.0, p + side * NEAR)), side) for p in (share, 1 - share) for side in (-1, 1))
    cuts = d.groupBy(*cell).agg(F.percentile_approx(score, [p for p, _ in at], round(4 / NEAR)).alias("__cuts"))
    cuts = materialise(cuts.select(*cell, *[F.element_at("__cuts", i + 1).alias(f"__c{i}") for i in range(4)]), "cuts")
    zone = sum(((s > F.col(f"__c{i}")) if side > 0 else (s >= F.col(f"__c{i}"))).cast("int") for i, (_, side) in enumerate(at))
    d = d.join(sent(cuts, 4), cell) if cell else attach(d, cuts)
    d = d.withColumn("__zone", zone).drop(*[f"__c{i}" for i in range(4)])
    whole = Window.partitionBy(*cell)
    upto = F.sum("__in").over(whole.orderBy("__zone").rowsBetween(Window.unboundedPreceding, 0))
    counts = d.groupBy(*key).agg(F.count(F.lit(1)).alias("__in"))
    places = counts.select(*key, (upto - F.col("__in")).alias("__lo"), upto.alias("__hi"), F.sum("__in").over(whole).alias("n"))
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    places = places.select(*key, "__lo", "__hi", k.alias("__k"), (F.col("n") - k).alias("__rest"))
    before, upto, k, rest = (F.col(x) for x in ("__lo", "__hi", "__k", "__rest"))
    rows = d.join(sent(materialise(places, "places"), len(key) + 4), key)
    split = (before < k) & (k < upto) | (before < rest) & (rest < upto)
    sure = rows.filter(~split).withColumns({"__first": upto <= k, "__last": before >= rest})
    near = exact_rank(materialise(rows.filter(split), "near"), key, score, tie, rank="__rn", total="__m")
    rn = before + F.col("__rn")
    return sure, near.withColumns({"__first": rn <= k, "__last": rn > rest})


def top_premium_of_ranked(ranked: DataFrame, cell: list[str], score: str, ret: str, cost: float, share: float = 0.10) -> DataFrame:
    """``top_premium`` of stored rows that are ranked upwards by (score, tie) already (rn, n); nothing is ordered again.

    The scores at both borders are looked up, then where their ties begin and end: of equal scores the lower ties are
    nearer to the top, so the first rows of the upper block and the last rows of the lower one complete the shares.
    """
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    s, rn = F.col(score), F.col("rn")
    at = {"hi": F.col("n") - k + 1, "lo": k}
    edge = sent(materialise(ranked.groupBy(*cell).agg(*[F.max(F.when(rn == i, s)).alias(f"__{e}") for e, i in at.items()]), "edges"), 2)
    r = ranked.join(edge, cell)
    ends = [f(F.when(s == F.col(f"__{e}"), rn)).alias(f"__{e}_{n}") for e in at for n, f in (("first", F.min), ("last", F.max))]
    blocks = sent(materialise(r.filter((s == F.col("__hi")) | (s == F.col("__lo"))).groupBy(*cell).agg(*ends), "blocks"), 4)
    r = r.join(blocks, cell)
    top = (s > F.col("__hi")) | (s == F.col("__hi")) & (rn - F.col("__hi_first") < k - (F.col("n") - F.col("__hi_last")))
    bot = (s < F.col("__lo")) | (s == F.col("__lo")) & (rn > F.col("__lo_last") - (k - F.col("__lo_first") + 1))
    return _premium(r, cell, top, bot, ret, cost)


def _premium(ranked: DataFrame, cell: list[str], top: Column, bot: Column, ret: str, cost: float) -> DataFrame:
    x = F.col(ret)
    out = ranked.groupBy(*cell).agg(
        F.count_if(top).alias("n_top"),
        F.avg(F.when(top, x)).alias("mean_top"),
        F.stddev_samp(F.when(top, x)).alias("sd_top"),
        F.count_if(bot).alias("n_bot"),
        F.avg(F.when(bot, x)).alias("mean_bot"),
        F.stddev_samp(F.when(bot, x)).alias("sd_bot"),
    )
    pss = F.col("mean_top") - cost
    t = F.when((F.col("sd_top") > 0) & (F.col("n_top") > 1), pss / (F.col("sd_top") / F.sqrt("n_top"))).otherwise(0.0)
    return out.withColumns({"pss": pss, "edge_over_cost": pss / cost, "t_stat": t}).withColumn("cohens_d", pooled_d("top", "bot"))


def pooled_d(a: str, b: str) -> Column:
    """df-weighted pooled effect size from n_, mean_, sd_ columns."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    var = ((na - 1) * F.pow(f"sd_{a}", F.lit(2)) + (nb - 1) * F.pow(f"sd_{b}", F.lit(2))) / (na + nb - 2)
    return F.when((F.least(na, nb) >= 2) & (var > 0), (F.col(f"mean_{a}") - F.col(f"mean_{b}")) / F.sqrt(var)).otherwise(0.0)


def rank_correlation(df: DataFrame, cell: list[str], a: str, b: str, out: str = "rank_ic") -> DataFrame:
    """Correlation of average ranks, with ties."""
    d = df.select(*cell, a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = d.groupBy(*cell, a, b).agg(F.count(F.lit(1)).alias("__w"))  # equal pairs collapse before any rank
    ra = value_ranks(_expand(d, cell, a), cell, a, {"w": F.col("__w")})
    rb = value_ranks(_expand(d, cell, b), cell, b, {"w": F.col("__w")})
    rank = F.col("below_w") + (F.col("w") + 1) / 2.0
    j = d.join(ra.select(*cell, a, rank.alias("__ra")), [*cell, a]).join(rb.select(*cell, b, rank.alias("__rb")), [*cell, b])
    w, x, y = F.col("__w"), F.col("__ra"), F.col("__rb")
    m = j.groupBy(*cell).agg(
        F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
    )
    return _correlation(m, cell, out)


def _correlation(m: DataFrame, cell: list[str], out: str, *more: str) -> DataFrame:
    c = F.col
    cov = c("sxy") - c("sx") * c("sy") / c("sw")
    vx, vy = c("sxx") - c("sx") * c("sx") / c("sw"), c("syy") - c("sy") * c("sy") / c("sw")
    return m.select(*cell, F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(0.0).alias(out), *more)


def _expand(d: DataFrame, cell: list[str], col: str) -> DataFrame:
    return d.groupBy(*cell, col).agg(F.sum("__w").alias("__w"))


def roc_pr_auc(df: DataFrame, cell: list[str], score: str, label: str) -> DataFrame:
    """Exact ROC area by rank sums and step-sum PR area, ties as one threshold."""
    return _areas(value_ranks(df.filter(F.col(label).isNotNull()), cell, score, {"pos": F.col(label).cast("double")}), cell)


def _areas(per: DataFrame, cell: list[str]) -> DataFrame:
    return _area_of(per.groupBy(*cell).agg(*_area_sums("ties")), cell)


def _area_sums(n: str) -> list[Column]:
    """Sums over distinct scores whose rows with a label are counted in column ``n``."""
    c = F.col
    neg = c(n) - c("pos")
    below_neg = c(f"below_{n}") - c("below_pos")
    # one threshold per distinct score: everything at or above it is called positive
    caught = c("total_pos") - c("below_pos")
    called = c(f"total_{n}") - c(f"below_{n}")
    return [
        F.sum(c("pos") * (below_neg + neg / 2.0)).alias("__wins"),
        F.max("total_pos").alias("__p"),
        F.max(f"total_{n}").alias("__n"),
        F.sum(F.when(c(n) > 0, c("pos") / c("total_pos") * caught / called)).alias("pr_auc"),
    ]


def _area_of(out: DataFrame, cell: list[str], *more: str) -> DataFrame:
    p, n = F.col("__p"), F.col("__n")
    return out.select(*cell, F.try_divide(F.col("__wins"), p * (n - p)).alias("auc"), "pr_auc", *more)


def areas_and_rank_correlation(df: DataFrame, cell: list[str], score: str, ret: str, label: str, out: str = "rank_ic") -> DataFrame:
    """``roc_pr_auc`` and ``rank_correlation`` from one order of the scores.

    Rows get the average rank of their outcome first.  Then one row per distinct score holds what both need: labelled
    rows and positive ones, rows with an outcome, and the sums of outcome ranks and of their squares.
    """
    d = df.select(*cell, score, ret, label).filter(F.col(score).isNotNull())
    y = value_ranks(d.select(*cell, ret), cell, ret).select(*cell, ret, F.col("avg_rank").alias("__y"))
    d = d.join(sent(materialise(y, "outcomes"), 2), [*cell, ret], "left")
    lab, has, y = F.col(label).isNotNull().cast("long"), F.col(ret).isNotNull().cast("long"), F.col("__y")
    pos = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    per = value_ranks(d, cell, score, {"pos": pos, "lab": lab, "w": has}, {"__y1": y, "__y2": y * y})
    w, x = F.col("w"), F.col("below_w") + (F.col("w") + 1) / 2.0
    m = per.groupBy(*cell).agg(
        *_area_sums("lab"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum("__y1").alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum("__y2").alias("syy"), F.sum(x * F.col("__y1")).alias("sxy"),
    )
    m = m.filter("__n > 0 AND sw > 0")
    return _area_of(_correlation(m, cell, out, "__wins", "__p", "__n", "pr_auc"), cell, out)


def probability_losses(p: Column, y: Column) -> list[Column]:
    """Log-loss, Brier score and accuracy at one half."""
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return [
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("logloss"),
        F.avg(F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)) - y, F.lit(2))).alias("brier"),
        F.avg(((p >= 0.5).cast("int") == y.cast("int")).cast("double")).alias("accuracy"),
    ]


def regression_losses(pred: Column, y: Column) -> list[Column]:
    """RMSE and R2 in one pass."""
    sse = F.sum(F.pow(y - pred, F.lit(2)))
    sst = F.var_pop(y) * F.count(y)
    return [F.sqrt(sse / F.count(y)).alias("rmse"), F.when(sst > 0, 1 - sse / sst).otherwise(0.0).alias("r2")]


def calibration_error(df: DataFrame, cell: list[str], p: str, y: str, tie: str, bins: int = 10) -> DataFrame:
    """Weighted gap between mean probability and frequency in equal-count chunks."""
    return chunked_gap(exact_rank(df.select(*cell, p, y, tie), cell, p, tie), cell, p, y, bins)


def chunked_gap(r: DataFrame, cell: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Calibration gap of rows already ranked by probability (rn, n)."""
    chunk = F.floor((F.col("rn") - 1) / F.ceil(F.col("n") / bins))
    g = r.groupBy(*cell, chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("m"), F.max("n").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my")
    )
    return g.groupBy(*cell).agg(F.sum(F.col("m") / F.col("n") * F.abs(F.col("mp") - F.col("my"))).alias("ece"))


def calibration_table(df: DataFrame, cell: list[str], p: str, y: str, bins: int = 20) -> DataFrame:
    """Label rate and mean probability per equal-width probability bin."""
    b = F.least(F.lit(bins - 1).cast("long"), F.floor(F.col(p) * bins))
    return df.groupBy(*cell, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("label_rate"), F.avg(p).alias("mean_proba")
    )


def kendall_over_buckets(table: DataFrame, cell: list[str], idx: str, value: str) -> DataFrame:
    """Tau-b of bucket index and value; a table of at most a few dozen rows per cell."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))))
    packed = table.groupBy(*cell).agg(rows.alias("rows"))
    # at most `buckets` entries per cell: pair signs inside one array expression
    signs = F.flatten(
        F.transform("rows", lambda a: F.transform(F.filter("rows", lambda b: b["i"] > a["i"]), lambda b: F.signum(b["v"] - a["v"])))
    )
    s = packed.select(*cell, signs.alias("s"), F.size("rows").alias("k"))
    total = F.aggregate("s", F.lit(0.0), lambda acc, z: acc + z)
    n0 = F.col("k") * (F.col("k") - 1) / 2.0
    tied = F.size(F.filter("s", lambda z: z == 0))
    return s.select(*cell, F.when(n0 - tied > 0, total / F.sqrt(n0 * (n0 - tied))).otherwise(0.0).alias("kendall_tau"))


def quantile_buckets(df: DataFrame, group: list[str], x: str, q: int, out: str = "bucket") -> DataFrame:
    """Right-closed buckets at exact quantile edges, duplicate edges merged."""
    probs = {f"__e{i}": i / q for i in range(q + 1)}
    edges = exact_quantiles(df, group, x, probs).select(
        *group, F.array_distinct(F.array(*[F.col(c) for c in probs])).alias("__edges")
    )
    v = F.col(x)
    place = F.greatest(F.lit(0), F.size(F.filter("__edges", lambda e: e < v)) - 1)
    return df.join(edges, group).withColumn(out, place.cast("long")).drop("__edges")
