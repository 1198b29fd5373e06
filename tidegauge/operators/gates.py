"""Acceptance gates, benchmark dominance and candidate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.ranking import exact_rank, running_in_rank

ALPHA, EDGE_MIN, AUC_MIN, IC_MIN, D_MIN, POWER_MIN = 0.05, 1.2, 0.55, 0.01, 0.30, 0.80  # fixed gate bounds
TOLERANCE = 1e-9


def nearest_benchmark(runs: DataFrame, benches: DataFrame, run: str, bench: str, value: str) -> DataFrame:
    """For each run the benchmark closest in ``value``; the lower benchmark wins a tie.

    Only the neighbours below and above in value order can be closest.  A run without a value has no nearest one.
    """
    marks = benches.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.min(bench).alias("__b"))
    place = F.pmod(F.xxhash64(run), F.lit(1 << 30)).cast("double")
    both = runs.select(run, F.col(value).alias("__v"), place.alias("__o")).unionByName(marks.withColumn("__o", F.lit(-1.0)), allowMissingColumns=True)
    mark = F.when(F.col("__o") < 0, F.struct(F.col("__v").alias("v"), F.col("__b").alias("b")))
    ranked = exact_rank(both.withColumn("__mark", mark), [], "__v", "__o", rank="__rank", total="__total")
    around = running_in_rank(ranked, [], "__rank", {"__lo": ("last", "__mark"), "__hi": ("next", "__mark")}).filter(F.col("__o") >= 0)
    around = around.unionByName(runs.filter(F.col(value).isNull()).select(run), allowMissingColumns=True)

    def gap(side: str) -> Column:
        m = F.col(side)
        return F.when(m.isNotNull(), F.struct(F.round(F.abs(m["v"] - F.col("__v")), 9).alias("g"), m["b"].alias("b")))

    return around.select(run, F.least(gap("__lo"), gap("__hi"))["b"].alias("nearest"))


def dominance(runs: DataFrame, benches: DataFrame, run: str, exposure: str, net: str) -> DataFrame:
    """True where some benchmark has no more exposure and no less net result, and is better in one of them.

    Differences below ``TOLERANCE`` do not count, so an identical benchmark dominates nothing.  Each run asks for
    the best net result at clearly less exposure, which must not be clearly worse, and at no more exposure,
    which must be clearly better; the running best net in order of exposure answers both.
    """
    marks = benches.select(F.col(exposure).alias("__e"), F.col(net).alias("__n"), F.lit(-1.0).alias("__o"))
    asked = F.explode(F.array(*[F.struct((F.col(exposure) + side * TOLERANCE).alias("e"), (F.col(net) + side * TOLERANCE).alias("need")) for side in (-1, 1)]))
    place = F.pmod(F.xxhash64(run), F.lit(1 << 30)).cast("double")
    probes = runs.select(run, asked.alias("q")).select(run, F.col("q.e").alias("__e"), F.col("q.need").alias("__need"), place.alias("__o"))
    ranked = exact_rank(probes.unionByName(marks, allowMissingColumns=True), [], "__e", "__o", rank="__rank", total="__total")
    best = running_in_rank(ranked, [], "__rank", {"__best": ("max", "__n")}).filter(F.col("__o") >= 0)
    best = best.unionByName(runs.filter(F.col(exposure).isNull()).select(run), allowMissingColumns=True)
    return best.groupBy(run).agg(F.coalesce(F.bool_or(F.col("__best") >= F.col("__need")), F.lit(False)).alias("dominated"))


def cell_support(auc: Column, r2: Column, ic: Column, tau: Column) -> Column:
    base = F.when(auc.isNotNull(), auc >= AUC_MIN).otherwise(F.coalesce(r2 > 0, F.lit(False)))
    return base & (F.coalesce(ic, F.lit(0.0)) >= IC_MIN) & (tau > 0)


def arm_gate(cells: DataFrame, family: str = "family") -> DataFrame:
    """Family verdict from per-cell q, auc/r2, rank_ic, kendall_tau, pss, edge, d, power."""
    c = F.col
    sig = c("q") < ALPHA
    r2 = c("r2") if "r2" in cells.columns else F.lit(None).cast("double")
    b = sig & cell_support(c("auc"), r2, c("rank_ic"), c("kendall_tau"))
    cc = b & (c("pss") > 0) & (c("edge_over_cost") >= EDGE_MIN)
    d = cc & (c("cohens_d") >= D_MIN) & (c("power") >= POWER_MIN)
    return cells.groupBy(family).agg(
        F.count_if(sig).alias("n_sig"),
        (F.count_if(sig) >= 1).alias("has_sig"),
        ((F.count_distinct(F.when(sig, c("block"))) >= 2) & (F.count_distinct(F.when(sig, c("model"))) >= 2)).alias(
            "a_two_blocks_two_models"
        ),
        (F.count_if(b) >= 1).alias("b_support"),
        (F.count_if(cc) >= 1).alias("c_edge"),
        (F.count_if(d) >= 1).alias("gate_pass"),
        F.max_by(
            F.when(d, c("cell_id")), F.when(d, F.struct(c("edge_over_cost"), -c("cell_rank")))
        ).alias("candidate"),
    )


def direction_consistency(runs: DataFrame, group: list[str], pss: str, need: float = 2 / 3) -> DataFrame:
    return runs.groupBy(*group).agg(
        F.avg((F.col(pss) > 0).cast("double")).alias("frac"),
        (F.avg((F.col(pss) > 0).cast("double")) >= need).alias("passed"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


INVALID_SHARE, USUAL_TURNOVER, TURNOVER_TIMES = 0.01, 86.7, 3  # fixed values: bounds of a run's checks


def _run_rules() -> dict[str, dict[str, Column]]:
    """Name of each finding and when it holds, by severity."""
    c = F.col
    per_day, idle = c("trades") / F.greatest(c("days"), F.lit(1.0)), (c("buys") == 0) & (c("sells") == 0)
    return {
        "hard_fails": {
            "nan_reward": c("nan_reward"),
            "bankrupt": c("bankrupt"),
            "invalid_rate": c("invalid") > INVALID_SHARE * F.greatest(c("steps"), F.lit(1)),
            "constant_observation": c("obs_var") == 0,
        },
        "warnings": {
            "zero_trade": c("trades") == 0,
            "only_hold": idle,
            "no_sell": ~idle & (c("sells") == 0),
            "excessive_turnover": per_day > TURNOVER_TIMES * USUAL_TURNOVER,
            "fee_above_gross": (c("gross") > 0) & (c("fees") > c("gross")),
        },
    }


def run_checks(df: DataFrame) -> DataFrame:
    """Hard failures and warnings of run records, as two text arrays and a verdict.

    Needs: steps, trades, buys, sells, invalid, days, fees, gross, nan_reward, bankrupt, obs_var.
    """
    found = {kind: F.array_compact(F.array(*[F.when(holds, name) for name, holds in rules.items()])) for kind, rules in _run_rules().items()}
    return df.withColumns(found).withColumn("passed", F.size("hard_fails") == 0)


def threshold_checks(delta: Column, win_rate: Column, max_dd: Column, seed_std: Column) -> dict[str, Column]:
    """Locked acceptance bounds of the model comparison (fixed values)."""
    parts = {
        "sharpe_delta_ok": delta >= 0.30,
        "win_rate_ok": win_rate >= 0.60,
        "max_dd_ok": F.abs(max_dd) <= 0.20,
        "seed_std_ok": seed_std < 0.25,
    }
    return {**parts, "all_pass": parts["sharpe_delta_ok"] & parts["win_rate_ok"] & parts["max_dd_ok"] & parts["seed_std_ok"]}
