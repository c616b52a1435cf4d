"""Chances from a logistic fit on grouped counts, with what each feature adds to the logit; and the rule for sparse histories."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S


def fitted(df: DataFrame, numbers: list[str], labels: list[str], hit: str) -> PipelineModel:
    """Logistic regression of hit (0 or 1) on numbers (median where missing, standardised) and labels (one-hot; null and
    unseen ones have a place of their own). Rows that agree in all of these are one weighted row for each outcome, so the
    fit sees no row a shot. Without a penalty, so the chances of the training rows sum to their hits."""
    held = df.where(F.col(hit).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in numbers), *(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")).alias(c) for c in labels), F.col(hit).cast("double").alias("_hit"))
    counts = held.groupBy(*numbers, *labels, "_hit").agg(F.count("*").cast("double").alias("_weight"))
    filled, index, hot = ([f"_{c}_{k}" for c in cols] for k, cols in (("filled", numbers), ("index", labels), ("hot", labels)))
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_numbers"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
    if labels:
        stages += [StringIndexer(inputCols=labels, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=["_scaled", *hot], outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol="_hit", weightCol="_weight", standardization=False, maxIter=200, tol=1e-10)]
    return Pipeline(stages=stages).fit(counts)


def feature_names(model: PipelineModel, numbers: list[str], labels: list[str], width: int) -> list[str]:
    """Names of the model's features in order; a label's last is that of unseen values."""
    names = list(numbers)
    if labels:
        indexer = next(s for s in model.stages if hasattr(s, "labelsArray"))
        for c, values in zip(labels, indexer.labelsArray, strict=True):
            names += [f"{c}={v}" for v in values] + [f"{c}=?"]
    return (names + [f"feature {i}" for i in range(len(names), width)])[:width]


def chances(df: DataFrame, model: PipelineModel, numbers: list[str], labels: list[str], most: int = 5) -> DataFrame:
    """df with chance, logit, and factors: of what the features add to the logit, coefficient times scaled value, the `most`
    largest in size, largest first (ties by name). `rest` is what the others and the intercept add."""
    lr = model.stages[-1]
    weights = lr.coefficients.toArray().tolist()
    names = feature_names(model, numbers, labels, len(weights))
    ready = df.withColumns({c: F.col(c).cast("double") for c in numbers} | {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")) for c in labels})
    x = model.transform(ready).withColumn("_x", vector_to_array("_features"))
    parts = F.array(*(F.struct((-F.abs(F.col("_x")[i] * w)).alias("size"), F.lit(n).alias("factor"), (F.col("_x")[i] * w).alias("value")) for i, (n, w) in enumerate(zip(names, weights, strict=True))))
    logit = F.aggregate("_parts", F.lit(float(lr.intercept)), lambda s, p: s + p["value"])
    top = F.transform(F.slice(F.array_sort("_parts"), 1, most), lambda p: F.struct(p["factor"].alias("factor"), p["value"].alias("value")))
    out = x.withColumn("_parts", parts).withColumns({"logit": logit, "factors": top})
    rest = F.col("logit") - F.aggregate("factors", F.lit(0.0), lambda s, p: s + p["value"])
    keep = [F.col(c) for c in df.columns if c not in (*numbers, *labels)]
    return out.select(*keep, *numbers, *labels, (1 / (1 + F.exp(-F.col("logit")))).alias("chance"), "logit", "factors", rest.alias("rest"))


def sparse(episodes: Column, muscle: Column, longest: Column, repeats: Column) -> Column:
    """Whether a history says too little for the model."""
    return (F.coalesce(episodes, F.lit(0)) == 0) & (F.coalesce(muscle, F.lit(0)) == 0) & longest.isNull() & repeats.isNull()


def rule(rate: Column, latest: Column, episodes: Column, repeats: Column, longest: Column, continuity: Column, days_since: Column, most: int = 5) -> dict[str, Column]:
    """Chance to be available by a fixed rule, and its factors, the largest in size first. A rate of 0 or null gives way to
    the latest period's, then to .70."""
    # The rule's base, its weights and its bounds.
    share = F.coalesce(F.nullif(rate.cast("double"), F.lit(0.0)), F.nullif(latest.cast("double"), F.lit(0.0)), F.lit(0.70))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    rest = F.when(days_since.isNotNull(), F.least(days_since.cast("double"), F.lit(180.0)) / 180.0 * 0.08).otherwise(0.0)
    steady = F.least(zero(continuity), F.lit(10.0)) * 0.018
    drawn = {"episodes": -0.035 * zero(episodes), "repeats": -0.14 * zero(repeats), "longest": -0.0015 * zero(longest), "continuity": steady, "days_since": rest}
    score = sum(drawn.values(), 0.52 + 0.38 * share)
    told = {"rate": (share - 0.5) * 0.38, **drawn}
    order = F.array_sort(F.array(*(F.struct((-F.abs(S.settled(v))).alias("size"), F.lit(i).alias("place"), F.lit(k).alias("factor"), v.alias("value")) for i, (k, v) in enumerate(told.items()))))
    return {"chance": S.settled(S.clamp(score, 0.20, 0.95)), "factors": F.transform(F.slice(order, 1, most), lambda p: F.struct(p["factor"].alias("factor"), p["value"].alias("value")))}
