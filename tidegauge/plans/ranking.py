"""Exact ranks inside large groups without one task per group.

Scores are cut into value buckets at approximate quantiles.  The cut points only
balance the work: ranks are exact because bucket counts are prefix-summed and
rows are numbered inside their bucket.  A score heavy enough to be a cut point
gets buckets of its own, split further by the tie-break column, so one repeated
score cannot fill a task either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.plans.single import attach
from tidegauge.plans.stage import materialise
from tidegauge.session import shuffle_width

BUCKET = "__bucket"
SLICE = "__slice"
SENT = 4_000_000  # numbers of a stored table that are sent to every task (32 MB)


def _cuts(df: DataFrame, group: list[str], score: str, tie: str | None, grid: int) -> DataFrame:
    """Cut points per group."""
    k = grid * grid
    probs = F.array(*[F.lit(i / k) for i in range(1, k)])
    aggs = [F.percentile_approx(score, probs, F.lit(max(1000, 10 * k))).alias("__cuts")]
    if tie:
        aggs += [F.min(tie).cast("double").alias("__tlo"), F.max(tie).cast("double").alias("__thi")]
    return df.groupBy(*group).agg(*aggs)


def sent(stored: DataFrame, width: int) -> DataFrame:
    """A stored table for a join: sent to every task while it holds ``SENT`` numbers at most, ``width`` to a row."""
    return F.broadcast(stored) if stored.count() * width <= SENT else stored


def bucketed(
    df: DataFrame,
    group: list[str],
    score: str,
    tie: str | None = None,
    grid: int | None = None,
) -> DataFrame:
    """Add order-preserving bucket columns for (score, tie) inside each group.

    Approximate quantiles depend on the order in which tasks are merged.  Bucket counts and rows must see the same
    cut points, so these are stored (one row per group) and never worked out twice.  They go to the rows: a join by
    group would put every row of a group into one task.  Only where there are so many groups that their cut points
    are too large for that are rows dealt by group.
    """
    grid = grid or max(4, min(64, math.ceil(math.sqrt(2 * shuffle_width(df.sparkSession)))))
    cuts = materialise(_cuts(df, group, score, tie, grid), "cuts")
    if group:
        cuts = sent(cuts, grid * grid)
    coarse = F.transform(F.sequence(F.lit(1), F.lit(grid - 1)), lambda i: F.element_at("__cuts", i * grid))
    cuts = cuts.withColumn("__coarse", coarse)
    s = F.col(score)

    def below(arr: Column, strict: bool) -> Column:
        return F.size(F.filter(arr, lambda c: (c < s) if strict else (c <= s)))

    # two-step search: coarse cut points first, then the one fine run between them;
    # each step is a column of its own so that it is evaluated once per row
    joined = df.join(cuts, group, "left") if group else attach(df, cuts)
    joined = joined.withColumn("__jump", below(F.col("__coarse"), True) * grid)
    joined = joined.withColumn("__under", F.col("__jump") + below(F.slice("__cuts", F.col("__jump") + 1, F.lit(grid)), True))
    exact = F.coalesce(F.try_element_at("__cuts", (F.col("__under") + 1).cast("int")) == s, F.lit(False))
    joined = joined.withColumn(BUCKET, (F.col("__under") * 2 + exact.cast("int")).cast("long")).drop("__jump", "__under")
    if tie:
        width = (F.col("__thi") - F.col("__tlo")) / F.lit(float(grid * grid)) + F.lit(1e-9)
        piece = F.floor((F.col(tie).cast("double") - F.col("__tlo")) / width).cast("long")
        joined = joined.withColumn(SLICE, F.when(F.col(BUCKET) % 2 == 1, piece).otherwise(F.lit(0).cast("long")))
        joined = joined.drop("__tlo", "__thi")
    else:
        joined = joined.withColumn(SLICE, F.lit(0).cast("long"))
    return joined.drop("__cuts", "__coarse")


def exact_rank(
    df: DataFrame,
    group: list[str],
    score: str,
    tie: str,
    rank: str = "rn",
    total: str = "n",
    grid: int | None = None,
) -> DataFrame:
    """1-based ascending row number by (score, tie) and group size, null scores dropped."""
    b = bucketed(df.filter(F.col(score).isNotNull()), group, score, tie, grid)
    counts = b.groupBy(*group, BUCKET, SLICE).agg(F.count(F.lit(1)).alias("__n"))
    across = Window.partitionBy(*group).orderBy(BUCKET, SLICE) if group else Window.partitionBy(F.lit(0)).orderBy(BUCKET, SLICE)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        *group,
        BUCKET,
        SLICE,
        F.coalesce(F.sum("__n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias(total),
    )
    local = Window.partitionBy(*group, BUCKET, SLICE).orderBy(F.col(score), F.col(tie))
    return (
        b.join(offsets, [*group, BUCKET, SLICE], "left")
        .withColumn(rank, (F.row_number().over(local) + F.col("__before")).cast("long"))
        .drop(BUCKET, SLICE, "__before")
    )


def value_ranks(
    df: DataFrame, group: list[str], score: str, weight: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, times: Column | None = None
) -> DataFrame:
    """One row per distinct score: count, rows below, average rank, group size.

    Ties are merged before anything is ordered, so a repeated score costs one row.  The merged scores feed the cut
    points, the bucket counts and the rows, so they are stored.
    ``weight`` adds per-score sums and their running totals below the score, ``sums`` adds per-score sums only.
    Where a row stands for several, ``times`` is their number.
    """
    extra = weight or {}
    merged = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*group, score)
        .agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("ties"), *[F.sum(c).alias(n) for n, c in {**extra, **(sums or {})}.items()])
    )
    names = ["ties", *extra]
    b = bucketed(materialise(merged, "merged"), group, score)
    parts = b.groupBy(*group, BUCKET).agg(*[F.sum(n).alias(f"__{n}") for n in names])
    key = group or [F.lit(0)]
    across = Window.partitionBy(*key).orderBy(BUCKET)
    offsets = parts.select(
        *group,
        BUCKET,
        *[
            F.coalesce(F.sum(f"__{n}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{n}")
            for n in names
        ],
        *[F.sum(f"__{n}").over(Window.partitionBy(*key)).alias(f"total_{n}") for n in names],
    )
    local = Window.partitionBy(*group, BUCKET).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    out = b.join(offsets, [*group, BUCKET], "left").withColumns(
        {f"below_{n}": F.coalesce(F.sum(n).over(local), F.lit(0)) + F.col(f"__b_{n}") for n in names}
    )
    return out.withColumn("avg_rank", F.col("below_ties") + (F.col("ties") + 1) / 2.0).drop(
        BUCKET, SLICE, *[f"__b_{n}" for n in names]
    )


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float], times: Column | None = None) -> DataFrame:
    """Linear-interpolation quantiles, exact, one output row per group.

    Works on merged distinct values; picks the two order statistics around each
    probability instead of holding a group's values in one task.
    """
    ranked = value_ranks(df, group, value, times=times)
    lo, hi = F.col("below_ties"), F.col("below_ties") + F.col("ties") - 1  # 0-based positions held
    aggs = []
    for name, p in probs.items():
        spot = F.lit(p) * (F.col("total_ties") - 1)
        left, right = F.floor(spot), F.ceil(spot)
        a = F.max(F.when((lo <= left) & (left <= hi), F.col(value)))
        c = F.max(F.when((lo <= right) & (right <= hi), F.col(value)))
        frac = F.max(spot - left)
        aggs.append((a + (c - a) * frac).alias(name))
    return ranked.groupBy(*group).agg(*aggs)


def running_in_rank(df: DataFrame, group: list[str], rank: str, parts: dict[str, tuple[str, str]], piece: int = 50_000) -> DataFrame:
    """Running values in the order of a dense rank, for groups of any size and for no group at all.

    ``parts`` are {out: (kind, column)}: ``last`` and ``next`` give the nearest value that is not null at or before and
    at or after a row, ``max`` the greatest up to it, ``min_after`` the least from it on.  Rows are ordered inside pieces
    of the rank; a piece's own value is carried on through one row for each piece.
    """
    piece_of = "__piece"
    cut = df.withColumn(piece_of, F.floor((F.col(rank) - 1) / piece).cast("long"))
    here = Window.partitionBy(*group, piece_of).orderBy(rank)
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy(piece_of)
    back, on = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    upto, since = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    kinds = {  # value of a piece; value over pieces; value inside; pieces and rows looked at; joined
        "last": (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(rank))), lambda c: F.last(c, True), back, upto, lambda x, y: F.coalesce(x, y)),
        "next": (lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(rank))), lambda c: F.first(c, True), on, since, lambda x, y: F.coalesce(x, y)),
        "max": (F.max, F.max, back, upto, F.greatest),
        "min_after": (F.min, F.min, on, since, F.least),
    }
    sums = cut.groupBy(*group, piece_of).agg(*[kinds[k][0](c).alias(f"__s_{o}") for o, (k, c) in parts.items()])
    carried = sums.select(*group, piece_of, *[kinds[k][1](f"__s_{o}").over(across.rowsBetween(*kinds[k][2])).alias(f"__c_{o}") for o, (k, _) in parts.items()])
    out = cut.join(carried, [*group, piece_of], "left")
    return out.withColumns({o: kinds[k][4](kinds[k][1](c).over(here.rowsBetween(*kinds[k][3])), F.col(f"__c_{o}")) for o, (k, c) in parts.items()}).drop(
        piece_of, *[f"__c_{o}" for o in parts]
    )
