"""Exact ranks under ties and hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import scoring
from tidegauge.plans import ranking
from tidegauge.plans.ranking import bucketed, exact_quantiles, exact_rank, value_ranks


@pytest.fixture(scope="module")
def tied(spark):
    """One group holds most rows and one score a third of them."""
    rng = np.random.default_rng(3)
    n = 3000
    score = np.where(rng.random(n) < 0.33, 5.0, rng.normal(5, 3, n).round(2))
    pdf = pd.DataFrame({"cell": np.where(rng.random(n) < 0.8, 0, 1), "id": rng.permutation(n), "score": score, "fwd": rng.normal(0, 1, n).round(2)})
    return pdf, spark.createDataFrame(pdf)


def test_exact_rank(tied):
    pdf, df = tied
    got = exact_rank(df, ["cell"], "score", "id").toPandas().sort_values("id")
    g = pdf.sort_values(["cell", "score", "id"])
    g["rn"] = g.groupby("cell").cumcount() + 1
    assert (got["rn"].to_numpy() == g.sort_values("id")["rn"].to_numpy()).all()


def test_heavy_score_is_spread(tied):
    _, df = tied
    sizes = bucketed(df, ["cell"], "score", "id").filter("score = 5.0").groupBy("cell", "__bucket", "__slice").count()
    assert sizes.count() > 4
    assert sizes.agg(F.max("count")).first()[0] < 0.3 * df.filter("score = 5.0").count()


def test_value_ranks_average(tied):
    pdf, df = tied
    got = value_ranks(df, ["cell"], "score").toPandas()
    pdf["r"] = pdf.groupby("cell")["score"].rank(method="average")
    want = pdf.groupby(["cell", "score"])["r"].first().reset_index()
    m = got.merge(want, on=["cell", "score"])
    assert len(m) == len(want)
    np.testing.assert_allclose(m["avg_rank"], m["r"])


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.937, 1.0])
def test_quantiles(tied, p):
    pdf, df = tied
    got = exact_quantiles(df, ["cell"], "score", {"q": p}).toPandas().set_index("cell")["q"]
    np.testing.assert_allclose(got.sort_index(), pdf.groupby("cell")["score"].quantile(p))


def test_decile_sizes_follow_integer_bounds(spark):
    for n in (7, 10, 23, 1000):
        df = spark.range(n).select(F.lit(0).alias("cell"), "id", F.col("id").cast("double").alias("score"))
        got = scoring.with_decile(df, ["cell"], "score", "id").groupBy("bucket").count().toPandas().set_index("bucket")["count"].to_dict()
        want = {b: (b + 1) * n // 10 - b * n // 10 for b in range(10)}
        assert got == {b: k for b, k in want.items() if k}


def test_monotone_scores(spark):
    rng = np.random.default_rng(7)
    s = rng.normal(size=1000)
    pdf = pd.DataFrame({"cell": 0, "id": range(1000), "score": s, "fwd": 0.5 * s + rng.normal(0, 0.1, 1000)})
    pdf["label"] = (pdf["fwd"] > 0).astype(int)
    df = spark.createDataFrame(pdf)
    t = scoring.decile_table(df, ["cell"], "score", "fwd", "id", 0.003).toPandas().sort_values("bucket")
    assert t["mean"].is_monotonic_increasing
    tau = scoring.kendall_over_buckets(spark.createDataFrame(t), ["cell"], "bucket", "mean").first()["kendall_tau"]
    assert tau == pytest.approx(1.0)
    assert scoring.roc_pr_auc(df, ["cell"], "score", "label").first()["auc"] > 0.9
    assert scoring.rank_correlation(df, ["cell"], "score", "fwd").first()["rank_ic"] == pytest.approx(pdf["score"].rank().corr(pdf["fwd"].rank()))


def test_top_premium_ramp(spark):
    pdf = pd.DataFrame({"cell": 0, "id": range(1000), "score": np.linspace(-1, 1, 1000), "fwd": np.linspace(-0.02, 0.02, 1000)})
    row = scoring.top_premium(spark.createDataFrame(pdf), ["cell"], "score", "fwd", "id", 0.003).first()
    assert row["n_top"] == 100
    assert row["mean_top"] == pytest.approx(pdf["fwd"].nlargest(100).mean())


@pytest.mark.parametrize("piece", [1, 7, 50_000])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_running_in_rank(spark, piece, group):
    rng = np.random.default_rng(piece)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 60) if group else 0, "x": np.where(rng.random(60) < 0.3, rng.normal(size=60), np.nan)})
    pdf["rank"] = pdf.groupby("g").cumcount() + 1
    df = spark.createDataFrame([(int(a), None if np.isnan(b) else float(b), int(c)) for a, b, c in pdf.itertuples(index=False)], "g int, x double, rank long").repartition(3)
    got = ranking.running_in_rank(df, group, "rank", {"a": ("last", "x"), "b": ("next", "x"), "c": ("max", "x"), "d": ("min_after", "x")}, piece).toPandas().sort_values(["g", "rank"])
    want = pdf.sort_values(["g", "rank"]).groupby("g").x
    back = lambda s: s[::-1]
    for name, f in (("a", lambda s: s.ffill()), ("b", lambda s: s.bfill()), ("c", lambda s: s.fillna(-np.inf).cummax()), ("d", lambda s: back(back(s).fillna(np.inf).cummin()))):
        w = want.transform(f).replace([np.inf, -np.inf], np.nan)
        assert np.allclose(got[name].to_numpy(float), w.to_numpy(), equal_nan=True), name


def test_nearest_and_dominance_and_fdr_against_loops(spark):
    from tidegauge.operators import gates, stats

    rng = np.random.default_rng(4)
    runs = [(f"r{k}", float(rng.integers(0, 8)) if k % 5 else 3.0, float(rng.integers(0, 5))) for k in range(60)] + [("none", None, 1.0)]
    benches = [(f"b{k}", float(rng.integers(0, 8)) + 0.5 * (k % 2), float(rng.integers(0, 5))) for k in range(9)]
    r, b = spark.createDataFrame(runs, "run string, e double, n double"), spark.createDataFrame(benches, "bench string, e double, n double")
    near = {x.run: x.nearest for x in gates.nearest_benchmark(r, b, "run", "bench", "e").collect()}
    over = {x.run: x.dominated for x in gates.dominance(r, b, "run", "e", "n").collect()}
    for name, e, n in runs:
        assert near[name] == (None if e is None else min((round(abs(x - e), 9), k) for k, x, _ in benches)[1])
        assert over[name] == (e is not None and any(x <= e and y >= n and (x < e or y > n) for _, x, y in benches))
    p = [(k % 3, f"t{k}", float(rng.choice([0.01, 0.2, 0.2, 0.9, rng.random()]))) for k in range(80)] + [(0, "null", None)]
    q = {x.t: x.q for x in stats.bh_adjust(spark.createDataFrame(p, "f int, t string, p double"), ["f"], "p", "t").collect()}
    for f in range(3):
        own = sorted((x, t) for g, t, x in p if g == f and x is not None)
        least = 1.0
        for rank in range(len(own), 0, -1):
            least = min(least, own[rank - 1][0] * len(own) / rank)
            assert q[own[rank - 1][1]] == pytest.approx(least)
    assert q["null"] is None


def test_ranks_hold_when_cut_points_come_out_differently_each_time(spark, tied, monkeypatch):
    """Merge order moves approximate quantiles; without reuse of exchanges every reader would work out its own."""
    import random

    pdf, df = tied
    plain, jitter = ranking._cuts, F.udf(lambda: random.SystemRandom().random() * 3, "double").asNondeterministic()
    moved = lambda *a: plain(*a).withColumn("__j", jitter()).withColumn("__cuts", F.transform("__cuts", lambda c: c + F.col("__j"))).drop("__j")
    monkeypatch.setattr(ranking, "_cuts", moved)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        ranks = exact_rank(df, ["cell"], "score", "id").groupBy("cell").agg(F.count_distinct("rn").alias("d"), F.max("rn").alias("hi"), F.count("rn").alias("n")).collect()
        got = {x.cell: x.q for x in exact_quantiles(df, ["cell"], "score", {"q": 0.5}).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert all(x.d == x.hi == x.n for x in ranks)
    assert got == pytest.approx(pdf.groupby("cell")["score"].quantile(0.5).to_dict())
