"""Bootstrap intervals and Monte-Carlo controls over hashed draws.

Row-level bootstraps weight every row per replicate (Poisson) and sum on the map
side, so what is shuffled is replicates, not rows.  Block and cluster bootstraps
draw indices and join them to block sums.  Matched controls send their pool to the
tasks that draw from it.  All draws are hashed (functions.rand).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.rand import poisson_array, poisson_weight, uniform, uniform_array
from tidegauge.plans.ranking import BUCKET, SLICE, bucketed, exact_rank, sent
from tidegauge.plans.series import Series, framed, number_rows
from tidegauge.plans.single import attach
from tidegauge.plans.stage import materialise
from tidegauge.session import shuffle_width


def _reps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _numbered(df: DataFrame, n: Column, out: str, by: list[str], piece: int = 50_000) -> DataFrame:
    """One row per integer in [0, n), laid out in pieces that are spread over tasks first."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / piece))).alias("__part")
    pieces = df.withColumn("__n_of", n).select("*", part).repartition(*by, "__part")
    lo = F.col("__part") * piece
    hi = F.least(F.col("__n_of"), lo + piece) - 1
    return pieces.withColumn(out, F.explode(F.sequence(lo, hi))).drop("__part", "__n_of")


def interval(draws: DataFrame, by: list[str], x: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval over replicates (a bounded number per group)."""
    q = F.percentile(x, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.groupBy(*by).agg(F.avg(x).alias("boot_mean"), q[0].alias("lo"), q[1].alias("hi"))


PIECE = 4096  # rows of equal outcome that share one draw
STEP = 1_000_000_007  # draws of further pieces start from row ids this far apart


def _pieces(cells: DataFrame) -> DataFrame:
    """Cells with ``at`` (their least row id) and ``n`` (rows), cut into pieces of bounded n with draws of their own."""
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE)))
    cut = cells.withColumn("__piece", piece).withColumn("n", F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("__piece") * PIECE))
    return cut.withColumn("at", F.col("at") + F.col("__piece") * STEP).drop("__piece")


def _weights(at: np.ndarray, n: np.ndarray, rep: np.ndarray, seed: int) -> np.ndarray:
    """Poisson weights of cells by replicates."""
    u = uniform_array(at[:, None], rep[None, :], seed)
    w = np.empty(u.shape, np.int64)
    for mean in np.unique(n):
        w[n == mean] = poisson_array(u[n == mean], int(mean))
    return w


def mean_diff_draws(df: DataFrame, by: list[str], x: str, in_a: Column, row: str, reps: int, seed: int, each: bool = False) -> DataFrame:
    """Replicated difference of two group means.

    Rows of one group, side and value are one cell, which weighs one Poisson number of its size in a replicate; with
    ``each`` every row has a draw of its own and stays in its task.  Tasks go through their cells by group and send
    one row for each group and replicate.
    """
    d = df.select(*by, F.col(x).cast("double").alias("x"), in_a.alias("side"), F.col(row).alias("at")).filter("x IS NOT NULL AND side IS NOT NULL")
    if each:
        cells = d.withColumn("n", F.lit(1).cast("long"))
    else:
        cells = _dealt(_pieces(d.groupBy(*by, "side", "x").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))))
    group = F.struct(F.lit(0).alias("_"), *by)
    cells = cells.select(group.alias("of"), F.xxhash64(group).alias("key"), "side", "x", "at", "n").sortWithinPartitions("key")

    def add(batches):
        rep, now, sums = np.arange(reps), None, np.zeros((4, reps))

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now] * reps, kind), pa.array(rep), *[pa.array(v) for v in sums]], ["of", "rep", "wa", "sa", "wb", "sb"])

        for batch in batches:
            kind = batch.schema.field("of").type
            of, (key, side, value, at, n) = batch.column("of"), (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "side", "x", "at", "n"))
            turns = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for first, last in zip(turns, turns[1:]):
                if first == last:
                    continue
                group = of[first].as_py()
                if now is not None and group != now:
                    yield done()
                    sums = np.zeros((4, reps))
                now = group
                for start in range(first, last, 64):
                    end = min(start + 64, last)
                    w = _weights(at[start:end], n[start:end], rep, seed)
                    for k, own in ((0, side[start:end]), (2, ~side[start:end])):
                        sums[k] += w[own].sum(0)
                        sums[k + 1] += value[start:end][own] @ w[own]
        if now is not None:
            yield done()

    of = cells.schema["of"].dataType
    schema = T.StructType([T.StructField("of", of), T.StructField("rep", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("wa", "sa", "wb", "sb")]])
    out = cells.mapInArrow(add, schema).groupBy("of", "rep").agg(*[F.sum(c).alias(c) for c in ("wa", "sa", "wb", "sb")])
    return out.select(*[F.col(f"of.{c}").alias(c) for c in by], "rep", (F.try_divide("sa", "wa") - F.try_divide("sb", "wb")).alias("diff"))


SIGMAS = 8.0
TURNS = 100  # replicates of one task


def cut_class(rank: Column, n: Column, share: float) -> Column:
    """0: inside the top share in every replicate, 2: in none, 1: near the cut, so that weights decide.

    The weight above a rank differs from its expectation by less than eight deviations; ``_cuts`` checks it.
    """
    first, last = _band(n, share)
    return F.when(rank <= first, 0).when(rank <= last, 1).otherwise(2)


def _band(n: Column, share: float) -> tuple[Column, Column]:
    """Ranks before the rows near the cut, and the last of them."""
    half = F.ceil(SIGMAS * F.sqrt(n * F.lit(share * (1 - share)))) + 50
    middle = F.ceil(n * share - 1e-9)
    return middle - half, middle + half


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells are few bytes but many draws: their tasks are a fixed number, which run-time coalescing leaves alone."""
    return cells.repartition(max(32, shuffle_width(cells.sparkSession)), "at")


def _by_cut(df: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by their side of both cuts: those far from both, those near one with exact ranks, and rows below each cut.

    Value buckets and their counts tell the side of all rows but those of the few buckets that hold a cut and its
    surroundings.  Only these are ordered, so most rows are neither shuffled nor sorted.
    """
    d = df.filter("__a IS NOT NULL AND __b IS NOT NULL")
    for c in "ab":
        d = bucketed(d, [], f"__{c}", "at").withColumnsRenamed({BUCKET: f"bucket_{c}", SLICE: f"slice_{c}"})
    d = materialise(d, "premium")
    below = []
    for c in "ab":
        key = [f"bucket_{c}", f"slice_{c}"]
        whole = Window.partitionBy(F.lit(0))
        upto = whole.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
        counts = d.groupBy(*key).agg(F.count(F.lit(1)).alias("__in"))
        places = counts.select(*key, F.sum("__in").over(upto).alias("__upto"), "__in", F.sum("__in").over(whole).alias("n"))
        last, before, n = F.col("__upto"), F.col("__upto") - F.col("__in"), F.col("n")
        side = cut_class(last, n, share)
        sure = F.when((cut_class(before + 1, n, share) == side) & (side != 1), side)
        places = materialise(places.select(*key, before.alias(f"before_{c}"), sure.alias(c), F.col("n").alias(f"n_{c}")), "places")
        below.append(places.agg(F.greatest(F.lit(0), F.coalesce(F.max(f"n_{c}") - _band(F.max(f"n_{c}"), share)[1], F.lit(0))).cast("long").alias(f"below_{c}")))
        d = d.join(sent(places, 5), key)
    d = d.select("at", "r", *[f"{x}{c}" for c in "ab" for x in ("", "__", "before_")], F.col("n_a").alias("n"))
    far = d.filter("a IS NOT NULL AND b IS NOT NULL").select("at", "r", "a", "b")
    near = materialise(d.filter("a IS NULL OR b IS NULL"), "near")
    for c in "ab":
        unsure = near.filter(F.col(c).isNull())
        ranked = attach(exact_rank(unsure, [], f"__{c}", "at", rank="__rn", total="__m"), unsure.agg(F.min(f"before_{c}").alias("__base")))
        ranked = ranked.withColumn(f"rank_{c}", F.col("__rn") + F.col("__base")).drop("__rn", "__m", "__base")
        ranked = ranked.withColumn(c, cut_class(F.col(f"rank_{c}"), F.col("n"), share))
        near = materialise(ranked.unionByName(near.filter(F.col(c).isNotNull()), allowMissingColumns=True), "near")
    return far, near.select("at", "r", "a", "b", "rank_a", "rank_b"), attach(*below)


def _sums(reps: int, seed: int):
    """Task that adds up the weights of its cells per replicate: in all, and above both cuts with outcomes."""

    def add(batches):
        rep = np.arange(reps)
        total, above, gain = np.zeros(reps, np.int64), np.zeros((2, reps), np.int64), np.zeros((2, reps))
        for batch in batches:
            at, n, r, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.argsort(n, kind="stable")
            step = max(1, 65_536 // reps)
            for i in range(0, len(order), step):
                some = order[i : i + step]
                w = _weights(at[some], n[some], rep, seed)
                total += w.sum(0)
                for side, c in enumerate((a[some], b[some])):
                    above[side] += w[c == 0].sum(0)
                    gain[side] += r[some][c == 0] @ w[c == 0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep, total, *above, *gain)], ["rep", "total", "above_a", "above_b", "gain_a", "gain_b"])

    return add


def _cuts(seed: int, share: float):
    """Group of one side and some replicates: goes down the rows near the cut until the share is full."""

    def cut(_, sums, band):
        near = band.sort_by("pos")
        at, r = near.column("at").to_numpy(), near.column("r").to_numpy()
        rows = []
        for s in sums.sort_by("rep").to_pylist():
            side = "ab"[s["side"]]
            k, before = math.ceil(s["total"] * share - 1e-9), s[f"above_{side}"]
            w = poisson_array(uniform_array(at, s["rep"], seed), 1)
            if s["total"] and not (s["below"] == 0 or before + w.sum() >= k) or before and before >= k:
                raise ValueError("a replicate's cut lies outside the rows near it")
            take = np.clip(k - before - (np.cumsum(w) - w), 0, w)
            rows.append((s["rep"], s["side"], float((s[f"gain_{side}"] + take @ r) / k) if k else None))
        names = ["rep", "side", "top"]
        return pa.table({n: pa.array([x[i] for x in rows], t) for i, (n, t) in enumerate(zip(names, (pa.int64(), pa.int32(), pa.float64())))})

    return cut


def premium_difference(df: DataFrame, a: str, b: str, ret: str, row: str, reps: int, seed: int, share: float = 0.1, each: bool = False) -> DataFrame:
    """Paired replicates of the mean outcome of the top share under two scores, with the same weights in both.

    Every row weighs Poisson(1) in a replicate.  Where it stands against both cuts is certain for all rows but those
    near a cut, some multiple of the root of all rows.  The others only count: rows of the same side of both cuts and
    the same outcome are one cell, whose weight is one Poisson number of its size.  So work is replicates times
    (outcomes + root of rows), tasks send one row per replicate, and a task near the cut holds that band only.
    With ``each`` there are no cells: every row has a draw of its own in every replicate, and work is replicates times rows.
    """
    d = df.select((-F.col(a)).alias("__a"), (-F.col(b)).alias("__b"), F.col(ret).alias("r"), F.col(row).alias("at"))
    far, near, below = _by_cut(d, share)
    both = far.unionByName(near.select("at", "r", "a", "b"))
    band = (F.col("a") == 1) | (F.col("b") == 1)
    if each:
        pieces = both.select("at", F.lit(1).cast("long").alias("n"), "r", "a", "b")
    else:
        cells = both.groupBy("a", "b", "r", F.when(band, F.col("at")).alias("own")).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
        pieces = _pieces(cells).select("at", "n", "r", "a", "b")
        pieces = _dealt(pieces)
    parts = pieces.mapInArrow(_sums(reps, seed), "rep long, total long, above_a long, above_b long, gain_a double, gain_b double")
    sums = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]])
    sums = attach(sums, below).withColumn("block", F.floor(F.col("rep") / TURNS))
    sums = sums.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("below", F.when(F.col("side") == 0, F.col("below_a")).otherwise(F.col("below_b")))
    near = near.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"rank_{c}").alias("pos"), (F.col(c) == 1).alias("is")) for i, c in enumerate("ab")]))).filter("s.is")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((reps - 1) // TURNS).cast("long")))
    near = near.select("at", "r", "s.side", "s.pos", blocks.alias("block"))
    tops = sums.groupBy("side", "block").cogroup(near.groupBy("side", "block")).applyInArrow(_cuts(seed, share), "rep long, side int, top double")
    wide = tops.groupBy("rep").agg(*[F.max(F.when(F.col("side") == i, F.col("top"))).alias(f"top_{c}") for i, c in enumerate("ab")])
    return wide.withColumn("delta", F.col("top_b") - F.col("top_a"))


def moving_block_theta(df: DataFrame, s: Series, r: str, k: int, reps: int, seed: int, lam: float) -> DataFrame:
    """Moving-block bootstrap of theta on ordered rows of each key.

    Every start's block sums (n, sum, sum of squares) come from one bounded
    frame; replicates draw starts and join the sums.
    """
    def build(d, b):
        f = b.w.rowsBetween(0, k - 1)
        x = F.col(r)
        return d.withColumns({"__c": F.count(x).over(f), "__s1": F.sum(x).over(f), "__s2": F.sum(x * x).over(f)})

    numbered = number_rows(df.select(*s.keys, s.ts, *s.ties, r), s, total="__n")
    blocks = framed(numbered, s, build, ahead=k, numbered=True).filter(F.col("__c") == k)
    ends = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= k)
    draws = _numbered(ends.withColumn("rep", _reps(reps)), F.ceil(F.col("__n") / k), "__i", [*s.keys, "rep"])
    starts = F.floor(uniform(F.col("__i"), F.col("rep"), seed) * (F.col("__n") - k + 1)).cast("long")
    draws = draws.select(*s.keys, "rep", starts.alias("pos"))
    # many draws hit one start: count them before joining the sums
    hits = draws.groupBy(*s.keys, "pos", "rep").agg(F.count(F.lit(1)).alias("__m"))
    j = hits.join(blocks.select(*s.keys, "pos", "__s1", "__s2"), [*s.keys, "pos"])
    return _theta_of_sums(j.withColumn("__c", F.lit(k)), [*s.keys, "rep"], lam)


def _theta_of_sums(j: DataFrame, by: list[str], lam: float) -> DataFrame:
    m = F.col("__m")
    g = j.groupBy(*by).agg(
        F.sum(m * F.col("__c")).alias("n"), F.sum(m * F.col("__s1")).alias("s1"), F.sum(m * F.col("__s2")).alias("s2")
    )
    mean = F.col("s1") / F.col("n")
    var = (F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1)
    return g.select(*by, F.when(var > 0, mean / F.sqrt(var) * F.lit(lam**0.5)).alias("theta"))


def calendar_block_theta(df: DataFrame, by: list[str], block: Column, r: str, reps: int, seed: int, lam: float) -> DataFrame:
    """Calendar-block bootstrap on whole blocks (weeks): blocks are summed first."""
    x = F.col(r)
    sums = df.groupBy(*by, block.alias("__b")).agg(F.count(x).alias("__c"), F.sum(x).alias("__s1"), F.sum(x * x).alias("__s2"))
    key = by or [F.lit(0)]
    idx = F.row_number().over(Window.partitionBy(*key).orderBy("__b")) - 1
    sums = sums.withColumns({"pos": idx.cast("long"), "__n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    draws = sums.select(*by, F.col("pos").alias("__i"), "__n").withColumn("rep", _reps(reps))
    pick = F.floor(uniform(F.col("__i"), F.col("rep"), seed) * F.col("__n")).cast("long")
    hits = draws.groupBy(*by, pick.alias("pos"), "rep").agg(F.count(F.lit(1)).alias("__m"))
    return _theta_of_sums(hits.join(sums.drop("__n"), [*by, "pos"]), [*by, "rep"], lam)


def cluster_mean_draws(clusters: DataFrame, by: list[str], key: str, x: str, reps: int, seed: int) -> DataFrame:
    """Replicated mean over clusters drawn with replacement; one row per cluster comes in."""
    part = by or [F.lit(0)]
    c = clusters.withColumns(
        {
            "pos": (F.row_number().over(Window.partitionBy(*part).orderBy(key)) - 1).cast("long"),
            "__n": F.count(F.lit(1)).over(Window.partitionBy(*part)),
        }
    )
    draws = c.select(*by, F.col("pos").alias("__i"), "__n").withColumn("rep", _reps(reps))
    pick = F.floor(uniform(F.col("__i"), F.col("rep"), seed) * F.col("__n")).cast("long")
    j = draws.select(*by, "rep", pick.alias("pos")).join(c.select(*by, "pos", x), [*by, "pos"])
    return j.groupBy(*by, "rep").agg(F.avg(x).alias("stat"))


def ratio_draws(df: DataFrame, by: list[str], r: str, row: str, reps: int, seed: int, per_year: float) -> DataFrame:
    """Replicated Sharpe of period returns by row weights."""
    w = df.select(*by, F.col(r).alias("__x"), F.col(row).alias("__id")).withColumn("rep", _reps(reps))
    w = w.withColumn("__m", poisson_weight(F.col("__id"), F.col("rep"), seed))
    x = F.col("__x")
    j = w.withColumns({"__c": F.lit(1), "__s1": x, "__s2": x * x})
    return _theta_of_sums(j, [*by, "rep"], per_year).withColumnRenamed("theta", "sharpe")


BLOCKS = 32  # parts that the replicates are dealt in
PLACES = 1 << 20  # positions of a pool that a task holds


def _looked_up(reps: int, per: int, seed: int):
    """Group of one regime, a piece of its pool and some replicates: sums of the outcomes drawn, up to each event count."""

    def look(key, pool, counts):
        start, block = key[1].as_py() * PLACES, key[2].as_py()
        rep, want = np.arange(block * per, min(reps, (block + 1) * per)), np.unique(counts.column("__want").to_numpy())
        size, most = counts.column("__size").to_numpy().max(initial=0), want.max(initial=0)
        x = np.empty(pool.num_rows)
        x[pool.column("__pos").to_numpy() - 1 - start] = pool.column("__x").to_numpy()
        sums, known = np.zeros((2, len(rep), len(want)))
        step = max(1, 65_536 // len(rep))
        for first in range(0, most, step):
            i = np.arange(first, min(first + step, most))
            at = np.floor(uniform_array(i[None, :], rep[:, None], seed) * size).astype(np.int64) - start
            # draws of an event count go on where those of the next smaller one end
            cell = np.arange(len(rep))[:, None] * len(want) + np.searchsorted(want, i, side="right")
            here = (at >= 0) & (at < len(x))
            at, cell = at[here], cell[here]
            there = ~np.isnan(x[at])
            sums += np.bincount(cell[there], x[at[there]], sums.size).reshape(sums.shape)
            known += np.bincount(cell[there], minlength=sums.size).reshape(sums.shape)
        values = (np.tile(want, len(rep)), np.repeat(rep, len(want)), sums.cumsum(1).ravel(), known.cumsum(1).ravel())
        return pa.table([pa.repeat(key[0], sums.size), *[pa.array(v) for v in values]], ["__of", "__want", "rep", "__sum", "__known"])

    return look


def matched_control(pool: DataFrame, events: DataFrame, by: list[str], regime: str, ret: str, order: str, reps: int, seed: int) -> DataFrame:
    """Control means drawn from the pool with the events' regime counts, per replicate.

    Draws name a position in the regime's pool; positions are exact ranks.  There are replicates times events of them,
    far more than rows, so the pool goes to the draws: a task holds a piece of one regime's pool and makes the draws of
    some replicates, and sends one row for each replicate and event count.  A draw is that of its number and replicate,
    whatever group it is for, so groups share it.  In pools of more than ``PLACES`` rows every piece goes through the draws.
    """
    of = F.col(regime).alias("__of")
    ranked = exact_rank(pool.select(of, F.col(ret).cast("double").alias("__x"), F.col(order).alias("__at")), ["__of"], "__at", "__at", rank="__pos", total="__n")
    sizes = pool.groupBy(of).agg(F.count(order).alias("__size"))
    want = events.groupBy(*by, of).agg(F.count(F.lit(1)).alias("__want"))
    per = -(-reps // BLOCKS)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // per)))
    key, width = ["__of", "__piece", "__block"], max(64, shuffle_width(pool.sparkSession))  # few bytes, many draws: a fixed number, as in _dealt
    rows = ranked.select("__of", F.floor((F.col("__pos") - 1) / PLACES).alias("__piece"), "__pos", F.coalesce("__x", F.lit(float("nan"))).alias("__x"))
    rows = rows.withColumn("__block", blocks).repartition(width, *key)
    counts = want.select("__of", "__want").distinct().join(sizes, "__of")
    counts = counts.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__size") - 1) / PLACES))))
    counts = counts.withColumn("__block", blocks).repartition(width, *key)
    longs, doubles = ([T.StructField(c, t()) for c in names] for names, t in ((("__want", "rep"), T.LongType), (("__sum", "__known"), T.DoubleType)))
    schema = T.StructType([T.StructField("__of", ranked.schema["__of"].dataType), *longs, *doubles])
    sums = rows.groupBy(*key).cogroup(counts.groupBy(*key)).applyInArrow(_looked_up(reps, per, seed), schema)
    return want.join(sums, ["__of", "__want"]).groupBy(*by, "rep").agg(F.try_divide(F.sum("__sum"), F.sum("__known")).alias("ctrl_mean"))


def control_p_value(draws: DataFrame, observed: DataFrame, by: list[str], obs: str, upper: bool = True) -> DataFrame:
    """Share of control replicates at least as extreme as the observed mean."""
    j = draws.join(observed.select(*by, obs), by)
    hit = (F.col("ctrl_mean") >= F.col(obs)) if upper else (F.col("ctrl_mean") <= F.col(obs))
    return j.groupBy(*by).agg(F.avg(hit.cast("double")).alias("mc_p"), F.max(obs).alias(obs), F.avg("ctrl_mean").alias("ctrl_mean"))


def random_reference(df: DataFrame, row: str, n: int, seed: int) -> DataFrame:
    """n rows in hashed order: a reproducible sample without replacement."""
    return df.orderBy(uniform(F.col(row), 0, seed), row).limit(n)
