"""Steps that must not grow faster than their input: what is joined, shuffled and read how often."""

import contextlib
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidegauge.functions.rand import uniform_array
from tidegauge.operators import resampling, scoring
from tidegauge.plans.ranking import bucketed, exact_quantiles, exact_rank
from tidegauge.sources import files
from tidegauge.sources.views import Views

SMALL = "/root/testdata/sf0.001"


@contextlib.contextmanager
def unsent(spark):
    """Run-time size checks never choose a broadcast: only what the code itself sends is sent."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tied(spark, n=3000):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"cell": rng.integers(0, 3, n), "id": np.arange(n), "score": rng.integers(0, 12, n) / 4.0, "fwd": rng.integers(-5, 6, n) / 100.0, "label": rng.integers(0, 2, n)})
    d = spark.createDataFrame(pdf)
    gone = lambda c, k: F.when(F.col("id") % k != 0, F.col(c)).alias(c)
    return d.select("cell", "id", gone("score", 37), gone("fwd", 11), gone("label", 7))


def test_cut_points_go_to_the_rows(spark):
    """A join by group would put a whole group into one task."""
    with unsent(spark):
        b = bucketed(tied(spark), ["cell"], "score", "id")
        assert "SortMergeJoin" not in plan(b) and "BroadcastHashJoin" in plan(b)


def test_premium_of_ranked_rows(spark):
    d = tied(spark)
    ranked = exact_rank(d, ["cell"], "score", "id")
    for share in (0.1, 0.37, 0.9):
        want = scoring.top_premium(d, ["cell"], "score", "fwd", "id", 0.003, share).orderBy("cell").toPandas()
        got = scoring.top_premium_of_ranked(ranked, ["cell"], "score", "fwd", 0.003, share).orderBy("cell").toPandas()
        pd.testing.assert_frame_equal(got, want)


def test_areas_and_rank_correlation_together(spark):
    d = tied(spark)
    got = scoring.areas_and_rank_correlation(d, ["cell"], "score", "fwd", "label").orderBy("cell").toPandas()
    areas, ic = scoring.roc_pr_auc(d, ["cell"], "score", "label"), scoring.rank_correlation(d, ["cell"], "score", "fwd")
    pd.testing.assert_frame_equal(got, areas.join(ic, "cell").orderBy("cell").toPandas())


def test_clusters_read_the_trades_once(spark):
    """Counts per cluster and result are stored; neither mean nor median goes back to the trades."""
    assert "lineitem" not in plan(queries()["cluster_bootstrap_mean"](spark, SMALL))


def test_quantiles_of_counted_values(spark):
    d = tied(spark).withColumn("n", F.lit(2) + F.col("id") % 3)
    each = d.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    want = exact_quantiles(each, ["cell"], "fwd", {"q1": 0.25, "q2": 0.5}).orderBy("cell").toPandas()
    pd.testing.assert_frame_equal(exact_quantiles(d, ["cell"], "fwd", {"q1": 0.25, "q2": 0.5}, F.col("n")).orderBy("cell").toPandas(), want)


def test_trades_move_results_not_their_parts(spark):
    with unsent(spark):
        p = plan(Views(spark, SMALL).trades.groupBy("pair").agg(F.avg("profit_ratio")))
    assert not any("l_discount" in line for line in p.split("Exchange hashpartitioning(l_orderkey")[0].splitlines())


def test_benchmarks_read_the_trades_once(spark):
    """Runs and benchmarks are told from stored sums by pair and year."""
    assert "lineitem" not in plan(queries()["nearest_by_value_benchmark"](spark, SMALL))


def test_only_rows_near_a_cut_are_ranked(spark):
    """Sides of both cuts are those of exact ranks, though most rows are told by their bucket alone."""
    n, share = 20_000, 0.1
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"at": np.arange(n), "r": rng.normal(size=n), "__a": rng.integers(0, 3000, n) / 7.0, "__b": rng.normal(size=n)})
    d = spark.createDataFrame(pdf)
    far, near, below = resampling._by_cut(d, share)
    assert near.count() < n / 2
    got = far.unionByName(near.select(*far.columns)).toPandas().sort_values("at")
    for c in "ab":
        rank = exact_rank(d, [], f"__{c}", "at", rank="rank", total="n")
        want = rank.select("at", "rank", resampling.cut_class(F.col("rank"), F.col("n"), share).alias("side")).toPandas().sort_values("at")
        assert (got[c].to_numpy() == want["side"].to_numpy()).all()
        assert below.first()[f"below_{c}"] == (want["side"] == 2).sum()
        ranked = near.filter(f"rank_{c} IS NOT NULL").toPandas().merge(want, on="at")
        assert (ranked[f"rank_{c}"] == ranked["rank"]).all() and (want["side"] == 1).sum() == (ranked["side"] == 1).sum()


def test_cells_of_many_draws_stay_dealt(spark):
    """Few bytes, many draws: run-time coalescing must not put all cells into one task."""
    cells = resampling._dealt(spark.range(1000).withColumnRenamed("id", "at"))
    cells.count()
    assert cells.rdd.getNumPartitions() >= 32


def test_premiums_order_only_rows_at_a_border(spark):
    """Tops and bottoms are those of exact ranks, though most rows are told by their zone alone."""
    n = 20_000
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"cell": rng.integers(0, 2, n), "id": rng.permutation(n), "score": rng.normal(size=n), "few": rng.integers(0, 9, n) / 4.0})
    d = spark.createDataFrame(pdf)
    for score in ("score", "few"):
        for share in (0.1, 0.37, 0.5, 1.0):
            sure, near = scoring._ends(d, ["cell"], score, "id", share)
            assert score == "few" or near.count() < n / 20
            got = sure.select("id", "__first", "__last").unionByName(near.select("id", "__first", "__last")).orderBy("id").toPandas()
            ranked = exact_rank(d, ["cell"], score, "id").orderBy("id").toPandas()
            k = np.maximum(1, np.ceil(ranked["n"] * share))
            assert (got["id"] == ranked["id"]).all()
            assert (got["__first"] == (ranked["rn"] <= k)).all() and (got["__last"] == (ranked["rn"] > ranked["n"] - k)).all()


def test_long_files_are_hashed_by_many_tasks(spark, tmp_path, monkeypatch):
    """The digest stays that of the whole file, though it is read in splits and carried from turn to turn."""
    noise = np.random.default_rng(9).integers(0, 256, 300_000).astype(np.uint8).tobytes()
    bom = b"\xef\xbb\xbf"
    kinds = {"noise": noise, "ends": noise + b"\n", "bom": bom + noise, "bom ends": bom + noise + b"\n", "crlf": b"a\r\nb\r\r\n\n" * 9_000, "no line": noise.replace(b"\n", b""), "marks": bom * 9_000, "lines": b"\n" * 70_000, "short": b"x\n"}
    for name, content in kinds.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "packed.gz").write_bytes(noise)  # not unpacked, and no fault if it is not gzip at all
    want = {(n, hashlib.sha256(c).hexdigest(), len(c)) for n, c in (kinds | {"packed.gz": noise}).items()}
    turns, carry = [], files._added
    monkeypatch.setattr(files, "SPAN", 50_000)
    monkeypatch.setattr(files, "_added", lambda *a: turns.append(len(a[0])) or carry(*a))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        assert {tuple(r) for r in files.file_digests(spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set(key, before)
    assert len(turns) > 4 and turns[0] == 0 and turns[-1] == 7


def test_control_draws_stay_in_their_tasks(spark, monkeypatch):
    """Replicates times events of them: before, run-time size checks took them for a small table and sent it through the driver."""
    rng = np.random.default_rng(11)
    n = 900
    pdf = pd.DataFrame({"who": rng.integers(0, 4, n), "of": rng.integers(0, 3, n), "id": rng.permutation(n) * 7, "x": rng.normal(size=n)})
    pdf.loc[::50, "x"] = None
    d, reps, seed = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None))), 70, 22
    hit = (F.col("id") % 3 == 0) & ((F.col("of") > 0) | (F.col("who") > 2))
    monkeypatch.setattr(resampling, "PLACES", 128)  # some pools are cut into pieces
    with unsent(spark):
        got = resampling.matched_control(d, d.filter(hit), ["who"], "of", "x", "id", reps, seed)
        assert not any("hashpartitioning" in line and "rep" in line and "pos" in line for line in plan(got).splitlines())
        got = got.orderBy("who", "rep").toPandas()
    pools = {k: g.sort_values("id")["x"].to_numpy() for k, g in pdf.groupby("of")}
    events = pdf[(pdf["id"] % 3 == 0) & ((pdf["of"] > 0) | (pdf["who"] > 2))].groupby(["who", "of"]).size()
    want = []
    for who in range(4):
        for rep in range(reps):
            drawn = [pools[of][(uniform_array(np.arange(k), np.array(rep), seed) * len(pools[of])).astype(int)] for of, k in events[who].items()]
            want.append((who, rep, np.nanmean(np.concatenate(drawn))))
    want = pd.DataFrame(want, columns=["who", "rep", "ctrl_mean"])
    assert max(map(len, pools.values())) > 256
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_control_pool_is_stored_once(spark):
    """It feeds ranks, sizes and events: the ticks are not read again for each."""
    assert "events.parquet" not in plan(queries()["matched_control_monte_carlo_published"](spark, SMALL))
