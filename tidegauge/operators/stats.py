"""Tests over grouped tables: moments in the plan, tails as result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import tails
from tidegauge.plans.ranking import exact_rank, running_in_rank, value_ranks


def moments(x: Column, suffix: str) -> list[Column]:
    return [
        F.count(x).alias(f"n_{suffix}"),
        F.avg(x).alias(f"mean_{suffix}"),
        F.stddev_samp(x).alias(f"sd_{suffix}"),
    ]


def one_sample_t(df: DataFrame, by: list[str], x: Column, null: float = 0.0) -> DataFrame:
    """t, effect size and one-sided p per group."""
    m = df.groupBy(*by).agg(*moments(x, "x"))
    t = (F.col("mean_x") - null) / (F.col("sd_x") / F.sqrt("n_x"))
    ok = (F.col("n_x") > 1) & (F.col("sd_x") > 0)
    out = m.withColumns({"t": F.when(ok, t).otherwise(0.0), "d": F.when(ok, (F.col("mean_x") - null) / F.col("sd_x")).otherwise(0.0)})
    return out.withColumn("p", F.when(ok, tails.t_greater("t", F.col("n_x") - 1)).otherwise(1.0))


def paired_t(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Paired test and dz on row differences, two-sided p."""
    out = one_sample_t(df, by, F.col(a) - F.col(b))
    return out.withColumn("p", tails.t_two_sided("t", F.col("n_x") - 1))


def welch(df: DataFrame, by: list[str], x: str, in_a: Column) -> DataFrame:
    """Welch t, degrees of freedom, interval, pooled effect and p per group."""
    v = F.col(x)
    m = df.groupBy(*by).agg(*moments(F.when(in_a, v), "a"), *moments(F.when(~in_a, v), "b"))
    va, vb = F.pow("sd_a", F.lit(2)) / F.col("n_a"), F.pow("sd_b", F.lit(2)) / F.col("n_b")
    se = F.sqrt(va + vb)
    dof = F.pow(va + vb, F.lit(2)) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    out = m.withColumns({"diff": F.col("mean_a") - F.col("mean_b"), "se": se, "dof": dof})
    from tidegauge.operators.scoring import pooled_d

    out = out.withColumns({"t": F.col("diff") / F.col("se"), "cohens_d": pooled_d("a", "b")})
    out = out.withColumns({"p": tails.t_two_sided("t", "dof"), "__tc": tails.t_quantile(F.lit(0.975), F.col("dof"))})
    return out.withColumns(
        {"ci_lo": F.col("diff") - F.col("__tc") * F.col("se"), "ci_hi": F.col("diff") + F.col("__tc") * F.col("se")}
    ).drop("__tc")


def simple_d(a: str, b: str) -> Column:
    """Effect size over the plain mean of both variances (named variant)."""
    pooled = F.sqrt((F.pow(f"sd_{a}", F.lit(2)) + F.pow(f"sd_{b}", F.lit(2))) / 2)
    return F.when(pooled > 0, (F.col(f"mean_{a}") - F.col(f"mean_{b}")) / pooled).otherwise(0.0)


def mann_whitney(df: DataFrame, by: list[str], x: str, in_a: Column) -> DataFrame:
    """U of the first sample, Cliff's delta and tie-corrected normal p with continuity."""
    per = value_ranks(df.withColumn("__a", in_a.cast("double")), by, x, {"a": F.col("__a")})
    t = F.col("ties").cast("double")
    g = per.groupBy(*by).agg(
        F.sum(F.col("a") * F.col("avg_rank")).alias("__ra"),
        F.max("total_a").alias("n_a"),
        F.max("total_ties").alias("__n"),
        F.sum(t * t * t - t).alias("__tt"),
    )
    na, nb, n = F.col("n_a"), F.col("__n") - F.col("n_a"), F.col("__n").cast("double")
    u = F.col("__ra") - na * (na + 1) / 2.0
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("__tt") / (n * (n - 1))))
    z = (F.greatest(u, na * nb - u) - na * nb / 2.0 - 0.5) / sd
    out = g.select(*by, na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"), u.alias("u"), (2 * u / (na * nb) - 1).alias("cliff_delta"), z.alias("z"))
    return out.withColumn("p", tails.normal_two_sided(F.greatest("z", F.lit(0.0))))


def sign_test(df: DataFrame, by: list[str], x: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.count_if(F.col(x) > 0).alias("k"), F.count(x).alias("n"))
    return g.withColumns({"frac": F.col("k") / F.col("n"), "p": tails.sign_test("k", "n")})


def bh_adjust(tests: DataFrame, family: list[str], p: str, tie: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values by rank within each family.

    Ranks are exact for families of any size, and so is the least value behind a rank: tests are ordered inside
    pieces of the rank only.  A test without p takes no part and has no q.  Equal p have equal q, so ``tie`` only
    fixes the order of work.
    """
    known = tests.withColumns({"__family": F.to_json(F.struct(F.lit(0).alias("_"), *family)), "__tie": F.pmod(F.xxhash64(tie), F.lit(1 << 30))})
    ranked = exact_rank(known, ["__family"], p, "__tie", rank="__rank", total="__m")
    ranked = ranked.withColumn("__raw", F.col(p) * F.col("__m") / F.col("__rank"))
    least = running_in_rank(ranked, ["__family"], "__rank", {"__least": ("min_after", "__raw")})
    least = least.withColumn(out, F.least(F.lit(1.0), F.col("__least"))).select(*tests.columns, out)
    return least.unionByName(tests.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def event_theta(df: DataFrame, by: list[str], r: str, years: float) -> DataFrame:
    """mean/sd times root of events per year, with win rate and profit factor."""
    from tidegauge.operators.ledger import profit_factor, win_rate

    x = F.col(r)
    per = F.count(x) / F.lit(years)
    theta = F.when((F.stddev_samp(x) > 0) & (F.count(x) > 1), F.avg(x) / F.stddev_samp(x) * F.sqrt(per)).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), theta.alias("theta"), F.avg(x).alias("mean_net"), win_rate(r).alias("win_rate"), profit_factor(r).alias("profit_factor")
    )


def difference_beta(df: DataFrame, by: list[str], dx: str, dy: str) -> DataFrame:
    """Correlation and beta of differences; covariance ddof 1 over variance ddof 0."""
    return df.groupBy(*by).agg(
        F.corr(dx, dy).alias("corr"),
        F.try_divide(F.covar_samp(dx, dy), F.var_pop(F.when(F.col(dy).isNotNull(), F.col(dx)))).alias("beta"),
        F.count(F.lit(1)).alias("n"),
    )


def power_table(effects: DataFrame, by: list[str], d: str, n: str) -> DataFrame:
    """Power of each grouped effect at its own and nearby sample sizes."""
    sizes = F.explode(F.array(*[F.struct(F.lit(m).alias("mult"), (F.col(n) * m).cast("double").alias("size")) for m in (0.5, 1.0, 2.0)]))
    g = effects.withColumn("__s", sizes).select(*by, d, F.col("__s.mult").alias("mult"), F.col("__s.size").alias("size"))
    return g.withColumns(
        {
            "power_two_sample": tails.power_two_sample(d, "size"),
            "power_one_sample": tails.power_one_sample(d, "size"),
        }
    )
