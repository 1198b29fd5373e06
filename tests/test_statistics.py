"""Tail probabilities against table constants; FDR, draws, resampling."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import tails
from tidegauge.functions.rand import mixed, poisson_weight, uniform
from tidegauge.operators import resampling, stats


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("t", "df", "p"),
    [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (2.042, 30, 0.05), (3.169, 10, 0.01)],
)
def test_t_table(spark, t, df, p):
    assert one(spark, tails.t_two_sided(F.lit(float(t)), F.lit(float(df)))) == pytest.approx(p, abs=2e-4)
    assert one(spark, tails.t_greater(F.lit(float(t)), F.lit(float(df)))) == pytest.approx(p / 2, abs=1e-4)
    assert one(spark, tails.t_quantile(F.lit(1 - p / 2), F.lit(float(df)))) == pytest.approx(t, rel=5e-4)


def test_normal_and_sign(spark):
    assert one(spark, tails.normal_two_sided(F.lit(1.959964))) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, tails.sign_test(F.lit(8.0), F.lit(10.0))) == pytest.approx(112 / 1024)
    assert one(spark, tails.sign_test(F.lit(5.0), F.lit(10.0))) == 1.0


def test_power_known_values(spark):
    """Textbook sample sizes: 64 per group for d=0.5, 175 for d=0.3, both at 80 %."""
    assert one(spark, tails.power_two_sample(F.lit(0.5), F.lit(64.0))) == pytest.approx(0.8015, abs=2e-3)
    assert one(spark, tails.power_two_sample(F.lit(0.3), F.lit(175.0))) == pytest.approx(0.80, abs=3e-3)
    assert one(spark, tails.power_one_sample(F.lit(0.3), F.lit(71.0))) == pytest.approx(0.80, abs=8e-3)


def test_null_goes_through(spark):
    assert one(spark, tails.t_greater(F.lit(None).cast("double"), F.lit(3.0))) is None


def test_bh_by_rank(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.4, 0.2, 0.05])], "i int, p double")
    q = stats.bh_adjust(df, [], "p", "i").orderBy("i").toPandas()["q"]
    np.testing.assert_allclose(q, [0.06, 0.075, 0.075, 0.4, 0.24, 0.075])


def test_two_samples(spark):
    rows = [(0, float(x), True) for x in range(1, 6)] + [(0, x / 10, False) for x in range(1, 6)]
    df = spark.createDataFrame(rows, "g int, x double, a boolean")
    u = stats.mann_whitney(df, ["g"], "x", F.col("a")).first()
    assert u["u"] == 25.0 and u["cliff_delta"] == 1.0
    wt = stats.welch(df, ["g"], "x", F.col("a")).first()
    assert wt["diff"] == pytest.approx(2.7)
    assert wt["ci_lo"] < 2.7 < wt["ci_hi"]


def test_draws_are_uniform_and_independent(spark):
    d = spark.range(20_000).select("id", uniform(F.col("id"), 0, 1).alias("a"), uniform(F.col("id"), 1, 1).alias("b"), uniform(F.col("id"), 0, 2).alias("c")).toPandas()
    for c in "abc":
        counts = np.histogram(d[c], bins=20, range=(0, 1))[0]
        assert ((counts - 1000) ** 2 / 1000).sum() < 50
    for x, y in (("a", "b"), ("a", "c")):
        assert abs(d[x].corr(d[y])) < 0.03
    assert abs(d["a"].autocorr()) < 0.03
    one_row = spark.range(5000).select(uniform(F.lit(123456789), F.col("id"), 7).alias("u")).toPandas()["u"]
    assert abs(one_row.mean() - 0.5) < 0.02 and abs(one_row.autocorr()) < 0.05
    w = spark.range(20_000).select(poisson_weight(F.col("id"), 3, 5).alias("w")).toPandas()["w"]
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06


def test_replicates_are_no_shifts_and_far_rows_no_twins(spark):
    ids = list(range(3000))
    far = [i + 2147483647 for i in ids]
    df = spark.createDataFrame([(i,) for i in ids + far], "id long")
    d = df.select("id", *[uniform(F.col("id"), rep, 4).alias(f"u{rep}") for rep in (3, 4)]).toPandas().set_index("id")
    assert d["u3"].nunique() == d["u4"].nunique() == 6000
    assert abs(np.corrcoef(d.loc[ids, "u3"], d.loc[far, "u3"])[0, 1]) < 0.06
    assert len(set(d["u3"]) & set(d["u4"])) == 0
    gaps = np.sort(d.loc[ids, "u3"].to_numpy())[:, None] - np.sort(d.loc[ids, "u4"].to_numpy())[None, :100]
    assert np.unique(np.round(gaps, 12), return_counts=True)[1].max() < 4  # no constant offset


def test_draws_stay_in_range(spark):
    big = spark.createDataFrame([(2**62,), (-5,), (0,)], "x long").select(mixed(F.col("x"), 10**9, 10**6).alias("m")).toPandas()["m"]
    assert ((big >= 0) & (big < 2147483647)).all()


def test_bootstrap_covers_normal_theory(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": 0, "id": range(800), "x": rng.normal(0, 1, 800), "a": [True, False] * 400})
    d = resampling.mean_diff_draws(spark.createDataFrame(pdf), ["g"], "x", F.col("a"), "id", 400, 9)
    row = resampling.interval(d, ["g"], "diff").first()
    se = np.sqrt(2 / 400)
    assert (row["hi"] - row["lo"]) == pytest.approx(2 * 1.96 * se, rel=0.2)


@pytest.mark.parametrize("n", [500, 9000])
def test_premium_difference_against_loop(spark, n):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(n), "s": rng.integers(0, 40, n).astype(float), "t": rng.normal(size=n), "r": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    got = resampling.premium_difference(df, "s", "t", "r", "id", 5, 13, 0.1).orderBy("rep").toPandas()
    wts = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("w", poisson_weight(F.col("id"), F.col("rep"), 13)).toPandas()
    for rep, g in wts.groupby("rep"):
        for score, top in (("s", "top_a"), ("t", "top_b")):
            g = g.sort_values([score, "id"], ascending=[False, True])
            k = int(np.ceil(g["w"].sum() * 0.1 - 1e-9))
            flat = np.repeat(g["r"].to_numpy(), g["w"].to_numpy())[:k]
            assert got.loc[got.rep == rep, top].iloc[0] == pytest.approx(flat.mean())


def test_premium_difference_of_equal_outcomes(spark):
    """Cells of many rows: the interval agrees with one of row weights."""
    rng = np.random.default_rng(8)
    n = 60_000
    pdf = pd.DataFrame({"id": np.arange(n), "s": rng.normal(size=n), "t": rng.normal(size=n)})
    pdf["r"] = (pdf.s > 1).astype(float) + rng.integers(0, 3, n)
    got = resampling.premium_difference(spark.createDataFrame(pdf), "s", "t", "r", "id", 200, 5).toPandas()
    tops = []
    for _ in range(100):
        w = rng.poisson(1, n)
        tops.append([np.repeat(pdf.r.to_numpy()[o := np.argsort(-pdf[c].to_numpy())], w[o])[: int(np.ceil(w.sum() * 0.1))].mean() for c in "st"])
    tops = np.array(tops)
    for i, c in enumerate(("top_a", "top_b")):
        assert got[c].mean() == pytest.approx(tops[:, i].mean(), abs=0.006) and got[c].std() == pytest.approx(tops[:, i].std(), rel=0.3)
    assert got["delta"].std() == pytest.approx((tops[:, 1] - tops[:, 0]).std(), rel=0.3)


def test_bootstraps_by_rows_draw_for_each_row(spark):
    """Rows of equal outcome keep draws of their own: weights by row and replicate, not one number for a cell."""
    from tidegauge.functions.rand import poisson_array, uniform_array

    rng, n, reps = np.random.default_rng(5), 3000, 7
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "id": rng.permutation(n) * 7, "x": rng.integers(0, 3, n) / 10, "s": rng.random(n), "t": rng.random(n)})
    df = spark.createDataFrame(pdf).repartition(3)
    got = resampling.mean_diff_draws(df, ["g"], "x", F.col("id") % 2 == 0, "id", reps, 9, each=True).toPandas().set_index(["g", "rep"])["diff"]
    for g, rep in got.index:
        own = pdf[pdf.g == g]
        w, a = poisson_array(uniform_array(own.id.to_numpy(), rep, 9), 1), (own.id % 2 == 0).to_numpy()
        assert got[g, rep] == pytest.approx(np.average(own.x[a], weights=w[a]) - np.average(own.x[~a], weights=w[~a]), abs=1e-12)
    deltas = resampling.premium_difference(df, "s", "t", "x", "id", reps, 9, each=True).toPandas().set_index("rep")["delta"]
    assert len(deltas) == reps
    for rep in deltas.index:
        top = []
        for c in "st":
            own = pdf.sort_values(c, ascending=False)
            w = poisson_array(uniform_array(own.id.to_numpy(), rep, 9), 1)
            k = -(-w.sum() // 10)
            top.append(np.clip(k - (w.cumsum() - w), 0, w) @ own.x / k)
        assert deltas[rep] == pytest.approx(top[1] - top[0], abs=1e-12)
