"""Incremental value of new features: arms on the same rows, and one member of the universe left out at a time.

BASE holds the features there were, NEW the added ones, FULL both.  All arms learn from and score the same rows, those
where every feature of FULL is known, so differences come from features alone.  The forests of arms are independent
fits and are submitted side by side; scores of all arms end up as columns of one pass over the test rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import tails
from tidegauge.operators import gates, models, stats
from tidegauge.operators.resampling import interval, premium_difference
from tidegauge.operators.scoring import top_premium
from tidegauge.plans.single import attach
from tidegauge.plans.stage import materialise

SIDE_BY_SIDE = 3


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which no column is missing."""
    return df.na.drop(subset=list(cols))


def arm_scores(train: DataFrame, test: DataFrame, arms: Mapping[str, Sequence[str]], label: str, keep: Sequence[str], model: str = "M2", **kw) -> DataFrame:
    """``keep`` columns of the test rows and one score column named after each arm.

    Without training rows of both classes nothing can be learned: scores are null.
    """
    every = list(dict.fromkeys(c for cols in arms.values() for c in cols))
    train = materialise(complete(train, [*every, label]).select(*every, label), "arm-train")
    low, high = train.agg(F.min(label), F.max(label)).first()
    if low == high:
        return complete(test, every).select(*keep, *[F.lit(None).cast("double").alias(a) for a in arms])
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        fitted = dict(zip(arms, pool.map(lambda cols: models.fit(train, cols, label, model, **kw), arms.values())))
    out = complete(test, every)
    for name, cols in arms.items():
        out = models.score(fitted[name], out, cols).withColumnRenamed("score", name)
    return out.select(*keep, *arms)


def arm_report(scores: DataFrame, arms: Mapping[str, Sequence[str]], ret: str, key: str, cost: float) -> DataFrame:
    """One row per arm: features, rows, premium of the top tenth with its test, and q over the arms."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(len(c)).alias("n_features"), F.col(a).alias("score")) for a, c in arms.items()]))
    long = scores.select(key, ret, each.alias("x")).select(key, ret, "x.*")
    top = top_premium(long, ["arm"], "score", ret, key, cost)
    top = top.withColumn("p", tails.t_greater("t_stat", F.col("n_top") - 1))
    counts = long.groupBy("arm", "n_features").agg(F.count(F.lit(1)).alias("n_test"), F.min("score").alias("least"), F.max("score").alias("most"))
    return stats.bh_adjust(counts.join(top, "arm"), [], "p", "arm")


def incremental(
    train: DataFrame, test: DataFrame, base: Sequence[str], new: Sequence[str], label: str, ret: str, key: str, cost: float, reps: int = 10_000, seed: int = 42, **kw
) -> DataFrame:
    """BASE, NEW and FULL with the paired interval of each premium less that of BASE, and the decision.

    An arm passes if its premium is significant over all arms, large enough against cost, and if the whole interval of
    its difference to BASE is above zero.
    """
    arms = {"BASE": list(base), "NEW": list(new), "FULL": [*base, *new]}
    scores = materialise(arm_scores(train, test, arms, label, [key, ret], **kw), "arms")
    report = materialise(arm_report(scores, arms, ret, key, cost), "arm-report")
    out = None
    for arm in arms:
        row = report.filter(F.col("arm") == arm)
        if arm != "BASE":
            d = interval(premium_difference(scores, "BASE", arm, ret, key, reps, seed), [], "delta")
            row = attach(row, d.select(F.col("boot_mean").alias("delta_mean"), F.col("lo").alias("delta_lo"), F.col("hi").alias("delta_hi")))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    passed = (F.col("q") < gates.ALPHA) & (F.col("edge_over_cost") >= gates.EDGE_MIN) & F.coalesce(F.col("delta_lo") > 0, F.lit(False))
    return out.withColumn("passed", passed)


def leave_one_out(
    members: Sequence[str], features: Callable[[Sequence[str]], tuple[DataFrame, DataFrame]], base: Sequence[str], new: Sequence[str], label: str, ret: str, key: str, cost: float, **kw
) -> DataFrame:
    """FULL again without each member: ``features`` builds (train, test) from the members that stay."""
    arms = {"FULL": [*base, *new]}

    def without(gone: str) -> DataFrame:
        train, test = features([m for m in members if m != gone])
        scores = materialise(arm_scores(train, test, arms, label, [key, ret], **kw), "left-out")
        return materialise(arm_report(scores, arms, ret, key, cost).withColumn("left_out", F.lit(gone)), "left-out-report")

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return reduce(DataFrame.unionByName, pool.map(without, members))
