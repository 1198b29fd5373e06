"""Data-level audits: recomputed against stored, causality, split matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(stored: DataFrame, fresh: DataFrame, key: Sequence[str], metrics: Sequence[str], tol: float) -> DataFrame:
    """One row per key and metric: both values, gap, and whether they agree."""

    def long(df: DataFrame, name: str) -> DataFrame:
        parts = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
        return df.select(*key, parts.alias("z")).select(*key, F.col("z.metric").alias("metric"), F.col("z.v").alias(name))

    j = long(stored, "stored").join(long(fresh, "fresh"), [*key, "metric"], "full_outer")
    gap = F.abs(F.col("stored") - F.col("fresh"))
    both_null = F.col("stored").isNull() & F.col("fresh").isNull()
    return j.withColumns({"gap": gap, "agrees": F.coalesce(gap <= tol, both_null)})


def causality_breaks(df: DataFrame, ts: str, cut: str, build: Callable[[DataFrame], DataFrame], digits: int = 9) -> DataFrame:
    """Rows up to ``cut`` whose features change when later rows are removed; empty if causal."""
    at = F.lit(cut).cast("timestamp")

    def prefix(x: DataFrame) -> DataFrame:
        x = x.filter(F.col(ts) <= at)
        num = {f.name: F.round(f.name, digits) for f in x.schema.fields if f.dataType.typeName() == "double"}
        return x.withColumns(num)

    return prefix(build(df)).exceptAll(prefix(build(df.filter(F.col(ts) <= at))))


def match_folds(results: DataFrame, folds: DataFrame, start: str, end: str) -> DataFrame:
    """Result windows against fold windows: matches, missing and duplicates per fold."""
    r = results.groupBy(start, end).agg(F.count(F.lit(1)).alias("__n"))
    j = folds.join(r, [start, end], "full_outer")
    n = F.coalesce("__n", F.lit(0))
    state = (
        F.when(F.col("fold").isNull(), "unknown_window").when(n == 0, "missing").when(n > 1, "duplicate").otherwise("matched")
    )
    return j.select("fold", start, end, n.cast("long").alias("n_results"), state.alias("state"))
