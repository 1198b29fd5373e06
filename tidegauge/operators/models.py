"""Scaling and scoring models on Spark ML, walk-forward runs over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.scoring import top_premium
from tidegauge.plans.single import attach
from tidegauge.plans.stage import materialise


def fit_normaliser(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of means and deviations of the training rows; a zero deviation becomes 1."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}__mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{c}__sd")]
    return train.agg(*aggs)


def normalise(df: DataFrame, fitted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Apply a fitted one-row table (a global aggregate, so one row by construction)."""
    out = attach(df, fitted)
    return out.withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__sd") for c in cols}).drop(
        *[f"{c}__{k}" for c in cols for k in ("mean", "sd")]
    )


def balanced(train: DataFrame, label: str) -> DataFrame:
    """Class weights n / (2 * n_class)."""
    one = F.col(label) == 1
    share = train.agg(F.avg(one.cast("double")).alias("__p"))
    return attach(train, share).withColumn("weight", F.when(one, 0.5 / F.col("__p")).otherwise(0.5 / (1 - F.col("__p")))).drop("__p")


def estimator(model: str, label: str, trees: int = 200, depth: int = 8, rounds: int = 500, seed: int = 42, classify: bool = True, rows: int = 1):
    """Model families: M1 linear (published penalties 1 and C = 1 are sums over rows, here means: 1 / rows), M2 forest, M3 boosting."""
    common = {"featuresCol": "features", "labelCol": label}
    if model == "M1":
        return LogisticRegression(weightCol="weight", regParam=1 / rows, **common) if classify else LinearRegression(elasticNetParam=0.0, regParam=1 / rows, **common)
    if model == "M2":
        kind = RandomForestClassifier if classify else RandomForestRegressor
        extra = {"weightCol": "weight"} if classify else {"featureSubsetStrategy": "all"}
        return kind(numTrees=trees, maxDepth=depth, minInstancesPerNode=50, seed=seed, **extra, **common)
    if model == "M3":
        kind = GBTClassifier if classify else GBTRegressor
        return kind(maxIter=rounds, stepSize=0.05, subsamplingRate=0.8, seed=seed, **common)
    raise ValueError(f"unknown model {model}")


def fit(train: DataFrame, cols: Sequence[str], label: str, model: str, classify: bool = True, **kw):
    """A fitted pipeline; rows with a missing feature or label do not teach."""
    stages = [VectorAssembler(inputCols=list(cols), outputCol="raw_features", handleInvalid="keep")]
    if model == "M1":
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    else:
        stages[0].setOutputCol("features")
    train = train.na.drop(subset=[*cols, label])
    pipeline = Pipeline(stages=[*stages, estimator(model, label, classify=classify, rows=max(1, train.count()), **kw)])
    return pipeline.fit(balanced(train, label) if classify else train)


def score(fitted, test: DataFrame, cols: Sequence[str], classify: bool = True) -> DataFrame:
    """Adds ``score``; classifiers give the probability of class 1.  Rows with a missing feature stay, without a score."""
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull()
    got = vector_to_array("probability")[1] if classify else F.col("prediction")
    return fitted.transform(test).withColumn("score", F.when(known, got)).select(*test.columns, "score")


def fit_score(
    train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, model: str, classify: bool = True, **kw
) -> DataFrame:
    """Scores of test rows by a model of the training rows."""
    return score(fit(train, cols, label, model, classify, **kw), test, cols, classify)


def base_rate(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """The trivial scorer: the training mean for every row."""
    return attach(test, train.agg(F.avg(label).alias("score")))


def walk_forward(df: DataFrame, folds: DataFrame, cols: Sequence[str], label: str, models: Sequence[str], **kw) -> DataFrame:
    """Out-of-fold scores of every model: each fold fits on its own past.

    The driver loops over folds (a few) and submits distributed fits.
    """
    out = None
    for f in folds.orderBy("fold").collect():
        train = df.filter(F.col("ts") < F.lit(f["train_end"])).filter(F.col("ts") >= F.lit(f["train_start"]))
        test = df.filter((F.col("ts") >= F.lit(f["validation_end"])) & (F.col("ts") < F.lit(f["test_end"])))
        for m in models:
            scored = base_rate(train, test, label) if m == "M0" else fit_score(train, test, cols, label, m, **kw)
            part = scored.withColumns({"fold": F.lit(f["fold"]), "model": F.lit(m)})
            out = part if out is None else out.unionByName(part)
    return out


def consistency(scores: DataFrame, cost: float) -> DataFrame:
    """Share of folds with a positive premium per model."""
    s = materialise(scores.select("model", "fold", "id", "score", "l2"), "oof")
    p = top_premium(s, ["model", "fold"], "score", "l2", "id", cost)
    return p.groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"), F.avg((F.col("pss") > 0).cast("double")).alias("positive_share"), F.avg("pss").alias("mean_pss")
    )
