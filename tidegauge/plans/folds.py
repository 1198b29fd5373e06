"""Walk-forward and calendar folds, and the split of rows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _ends(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.unix_seconds(F.min(ts)).alias("lo"), F.unix_seconds(F.max(ts)).alias("hi"))


def rolling_folds(
    df: DataFrame, ts: str, train_days: int, validation_days: int, test_days: int, step_days: int, expanding: bool = False
) -> DataFrame:
    """Fold bounds from the data's own first and last instant; half-open windows."""
    length = (train_days + validation_days + test_days) * DAY
    e = _ends(df, ts)
    count = F.floor((F.col("hi") - F.col("lo") - length) / (step_days * DAY))
    i = F.explode(F.when(count >= 0, F.sequence(F.lit(0).cast("long"), count)))
    f = e.select("lo", i.alias("fold"))
    start = F.col("lo") + F.col("fold") * step_days * DAY
    train_end = start + train_days * DAY
    at = F.timestamp_seconds
    return f.select(
        "fold",
        at(F.col("lo") if expanding else start).alias("train_start"),
        at(train_end).alias("train_end"),
        at(train_end + validation_days * DAY).alias("validation_end"),
        at(train_end + (validation_days + test_days) * DAY).alias("test_end"),
    )


def calendar_folds(df: DataFrame, ts: str, n: int, min_train_share: float = 0.5) -> DataFrame:
    """Expanding folds: equal test windows over the tail, training on all before."""
    e = _ends(df, ts)
    first = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * min_train_share)
    width = F.floor((F.col("hi") - first) / n)
    f = e.select("lo", first.alias("first"), width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold"))
    train_end = F.col("first") + F.col("fold") * F.col("width")
    at = F.timestamp_seconds
    return f.select(
        F.col("fold").cast("long").alias("fold"),
        at("lo").alias("train_start"),
        at(train_end).alias("train_end"),
        at(train_end).alias("validation_end"),
        at(train_end + F.col("width")).alias("test_end"),
    )


def assign(df: DataFrame, folds: DataFrame, ts: str, only: str | None = None) -> DataFrame:
    """Rows in every fold window that holds them, tagged train/validation/test.

    ``only`` names one part: rows meet just the folds that hold them there, so those of the other parts are not
    multiplied first.  The fold table has one row per step of the time range (a century by days is 36 525), whatever
    the rows are, so it is broadcast.
    """
    t = F.col(ts)
    if only:
        begin, end = {"train": ("train_start", "train_end"), "validation": ("train_end", "validation_end"), "test": ("validation_end", "test_end")}[only]
        return df.join(F.broadcast(folds), (t >= F.col(begin)) & (t < F.col(end))).withColumn("part", F.lit(only))
    part = F.when(t < F.col("train_end"), "train").when(t < F.col("validation_end"), "validation").otherwise("test")
    cond = (t >= F.col("train_start")) & (t < F.col("test_end"))
    return df.join(F.broadcast(folds), cond).withColumn("part", part)


def overlap_report(folds: DataFrame) -> DataFrame:
    """Days between one fold's test end and the next fold's training start."""
    gap = F.datediff("train_start", F.lag("test_end").over(Window.orderBy("fold"))).cast("long")
    return folds.select("fold", gap.alias("gap_days"), F.coalesce(gap < 0, F.lit(False)).alias("overlaps"))


def bounds_broken(folds: DataFrame) -> DataFrame:
    """Folds whose bounds are out of order; empty when all are sound."""
    ok = (
        (F.col("train_start") < F.col("train_end"))
        & (F.col("train_end") <= F.col("validation_end"))
        & (F.col("validation_end") < F.col("test_end"))
    )
    return folds.filter(~ok)
