"""Projection of several targets and of a starter's chance from one feature pass, with intervals from out-of-fold residuals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrank.models.estimators import guard, matrix, without_summary
from cohortrank.storage import written_once

FOLDS, LOW_SAMPLE = 3, 20


@dataclass
class Projections:
    """A model and residual quantiles (.1, .9) for each target, the starter model, and the training rows of each pair."""

    numbers: list[str]
    labels: list[str]
    pair: list[str]
    prepared: PipelineModel
    targets: dict[str, tuple[GBTRegressionModel, float, float]]
    starter: LogisticRegressionModel
    pairs: DataFrame


def aligned(df: DataFrame, numbers: list[str], labels: list[str]) -> DataFrame:
    """df with every feature column: those that it lacks are null, empty labels are '-'."""
    have = set(df.columns)
    columns = {c: (F.col(c) if c in have else F.lit(None)).cast("double") for c in numbers}
    columns |= {c: F.coalesce(F.nullif((F.col(c) if c in have else F.lit(None)).cast("string"), F.lit("")), F.lit("-")) for c in labels}
    return df.withColumns(columns)


def fit_targets(df: DataFrame, key: list[str], numbers: list[str], labels: list[str], targets: list[str], starter: str, pair: list[str], folds: int = FOLDS) -> Projections:
    """Boosted trees for each target and a logistic regression of starter (0 or 1), all on one table of features.

    Rows are dealt to folds by the hash of their key, so rows that repeat a key share a fold. A row's residual comes from
    a model that did not see its fold: residuals of rows that a model has seen are too small, and intervals made of them
    too narrow. Features are medians, scales and places of labels, none of which looks at a target. Rows without a target
    take no part in its models; too few rows raise TooFewRows. pair names the columns whose training rows are counted.
    """
    guard(df, "projection")
    rows = aligned(df, numbers, labels)
    prepared = Pipeline(stages=matrix(numbers, labels)).fit(rows)
    fold = F.pmod(F.xxhash64(*key), F.lit(folds)).alias("_fold")
    held = written_once(prepared.transform(rows).select("features", fold, *(F.col(c).cast("double").alias(c) for c in [*targets, starter])), "features")
    models = {}
    for target in targets:
        own = held.where(F.col(target).isNotNull()).select("features", "_fold", F.col(target).alias("label"))
        guard(own, "projection")
        trees = GBTRegressor(maxIter=20, maxDepth=4, seed=42)
        parts = [trees.fit(own.where(F.col("_fold") != i)).transform(own.where(F.col("_fold") == i)) for i in range(folds)]
        left = parts[0]
        for p in parts[1:]:
            left = left.unionByName(p)
        low, high = left.select(F.percentile_approx(F.col("label") - F.col("prediction"), F.array(F.lit(0.1), F.lit(0.9)), 10000).alias("q")).first()["q"]
        models[target] = (trees.fit(own), low, high)
    seen = held.where(F.col(starter).isNotNull()).select("features", F.col(starter).alias("label"))
    logistic = without_summary(df.sparkSession, LogisticRegression(regParam=0.001, maxIter=100).fit(seen))
    pairs = written_once(rows.groupBy(*pair).agg(F.count("*").alias("pair_rows")), "pairs")
    return Projections(list(numbers), list(labels), list(pair), prepared, models, logistic, pairs)


def project_targets(df: DataFrame, fitted: Projections) -> DataFrame:
    """df with <target>_p10, _p50 and _p90 (not below 0, in this order), starter_chance, pair_rows, and low_sample where
    its pair had fewer than LOW_SAMPLE training rows. Feature columns that df lacks count as null, unseen labels have a
    place of their own; the feature columns return as aligned() makes them. All rows are scored in one pass."""
    x = fitted.prepared.transform(aligned(df, fitted.numbers, fitted.labels))
    columns = [*dict.fromkeys([*df.columns, *fitted.numbers, *fitted.labels])]
    x = x.select(*columns, "features")
    out = []
    for n, (target, (model, low, high)) in enumerate(fitted.targets.items()):
        x = model.copy().setPredictionCol(f"_p{n}").transform(x)
        p50 = F.greatest(F.lit(0.0), F.col(f"_p{n}"))
        out += [F.greatest(F.lit(0.0), F.least(p50, F.col(f"_p{n}") + low)).alias(f"{target}_p10"), p50.alias(f"{target}_p50"), F.greatest(p50, F.col(f"_p{n}") + high).alias(f"{target}_p90")]
    x = fitted.starter.copy().setPredictionCol("_starts").setProbabilityCol("_chance").setRawPredictionCol("_raw").transform(x)
    scored = x.select(*columns, *out, vector_to_array("_chance")[1].alias("starter_chance"))
    found = scored.join(fitted.pairs, fitted.pair, "left").withColumn("pair_rows", F.coalesce("pair_rows", F.lit(0)))
    return found.withColumn("low_sample", F.col("pair_rows") < LOW_SAMPLE).select(*scored.columns, "pair_rows", "low_sample")
