"""Models on Spark ML, fitted on all rows; model.transform() scores all entities at once."""

from __future__ import annotations

import uuid

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrank.operators.ranks import exact_percentiles
from cohortrank.storage import shared_folder

#: Fewest training rows of the projection, availability and value models.
LEAST_ROWS = {"projection": 30, "availability": 50, "value": 20}


class TooFewRows(ValueError):
    """Not enough rows to train on."""


def guard(df: DataFrame, model: str) -> None:
    if (n := df.limit(LEAST_ROWS[model]).count()) < LEAST_ROWS[model]:
        raise TooFewRows(f"{model}: {n} rows")


def without_summary(spark: SparkSession, model: Model) -> Model:
    """model as its file in the shared folder has it. A logistic regression just fitted carries the summary of its training
    and with it the session, which no task can take along once anything in that session has used an Observation."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    return type(model).load(path)


def matrix(numbers: list[str], labels: list[str] = ()) -> list:
    """Median imputation and scaling of numbers, one-hot labels; unseen labels get a slot of their own."""
    filled = [f"{c}_filled" for c in numbers]
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=filled)]
    if labels:
        stages += [StringIndexer(inputCols=list(labels), outputCols=[f"{c}_index" for c in labels], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_index" for c in labels], outputCols=[f"{c}_hot" for c in labels], handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=[*filled, *(f"{c}_hot" for c in labels)], outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    return stages


def role_clusters(df: DataFrame, numbers: list[str], ks: tuple[int, ...] = (4, 5, 6), seeds: tuple[int, ...] = (42, 43, 44)) -> tuple[PipelineModel, KMeansModel]:
    """Best k by silhouette, and for each k the seed of least cost."""
    prepared = Pipeline(stages=matrix(numbers)).fit(df)
    x = prepared.transform(df).select("features").persist()
    try:
        judge = ClusteringEvaluator(distanceMeasure="squaredEuclidean")
        best = None
        for k in ks:
            model = min((KMeans(k=k, seed=s).fit(x) for s in seeds), key=lambda m: m.summary.trainingCost)
            score = judge.evaluate(model.transform(x))
            if best is None or score > best[0]:
                best = (score, model)
    finally:
        x.unpersist()
    return prepared, best[1]


def with_roles(df: DataFrame, prepared: PipelineModel, clusters: KMeansModel, near: float = 1.15) -> DataFrame:
    """Nearest cluster, the second if at most `near` times as far, and confidence 1 - nearest / sum."""
    from pyspark.ml.functions import vector_to_array

    x = prepared.transform(df).withColumn("_x", vector_to_array("features"))
    far = F.array(*(
        F.struct(F.sqrt(F.aggregate(F.zip_with("_x", F.array(*(F.lit(float(v)) for v in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("d"), F.lit(i).alias("cluster"))
        for i, c in enumerate(clusters.clusterCenters())
    ))
    x = x.withColumn("_d", F.array_sort(far))
    first, second = F.col("_d")[0], F.col("_d")[1]
    total = F.aggregate("_d", F.lit(0.0), lambda s, v: s + v["d"])
    return x.select(*df.columns, first["cluster"].alias("primary_role"), F.when(second["d"] <= near * first["d"], second["cluster"]).alias("secondary_role"), F.when(total > 0, 1 - first["d"] / total).otherwise(1.0).alias("confidence"))


def projection(df: DataFrame, numbers: list[str], labels: list[str], target: str) -> tuple[PipelineModel, tuple[float, float]]:
    """Boosted trees for a target, and the 10 and 90 per cent quantiles of its residuals."""
    guard(df, "projection")
    model = Pipeline(stages=[*matrix(numbers, labels), GBTRegressor(labelCol=target, maxIter=20, maxDepth=4, seed=42)]).fit(df)
    low, high = exact_percentiles(model.transform(df).select((F.col(target) - F.col("prediction")).alias("residual")), "residual", [0.1, 0.9])
    return model, (low, high)


def project(df: DataFrame, model: PipelineModel, residuals: tuple[float, float]) -> DataFrame:
    low, high = residuals
    return model.transform(df).select(*df.columns, F.greatest(F.lit(0.0), F.col("prediction") + low).alias("p10"), F.col("prediction").alias("p50"), (F.col("prediction") + high).alias("p90"))


def quantile_values(df: DataFrame, numbers: list[str], labels: list[str], target: str) -> PipelineModel:
    """Quantiles .1, .5 and .9 of a positive target by accelerated failure time; Spark ML has no linear quantile
    regression."""
    guard(df, "value")
    aft = AFTSurvivalRegression(labelCol=target, censorCol="_seen", quantileProbabilities=[0.1, 0.5, 0.9], quantilesCol="quantiles")
    return Pipeline(stages=[*matrix(numbers, labels), aft]).fit(df.withColumn("_seen", F.lit(1.0)))


def classifier(df: DataFrame, numbers: list[str], target: str, trees: bool = True) -> PipelineModel:
    guard(df, "availability")
    last = GBTClassifier(labelCol=target, maxIter=20, seed=42) if trees else LogisticRegression(labelCol=target)
    model = Pipeline(stages=[*matrix(numbers), last]).fit(df)
    return model if trees else without_summary(df.sparkSession, model)
