"""Aggregations with the library's null and tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_exposure(df: DataFrame, metrics: list[str], exposure: str = "exposure", per: float = 90.0, low: float = 20.0) -> DataFrame:
    """Rows of exposure 1 or more with <metric>_rate for each metric and low_exposure."""
    rated = df.where(F.col(exposure) >= 1)
    rates = {f"{m}_rate": (F.col(m) / F.col(exposure) * per if m in df.columns else F.lit(None).cast("double")) for m in metrics}
    return rated.withColumns(rates | {"low_exposure": F.col(exposure) < low})


def exact_mean(value: Column) -> Column:
    """Mean of doubles by a sum of decimals, so that equal values give an equal mean in any order of rows. Where a value is
    beyond the decimals (1e26, not finite) it is the plain mean."""
    exact = value.cast("double").try_cast("decimal(38,12)")
    return F.when(F.count(exact) == F.count(value), F.try_sum(exact).cast("double") / F.nullif(F.count(value), F.lit(0))).otherwise(F.avg(value))


def modal(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """The most frequent value of each key, the smallest at a tie; nulls don't count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    best = counted.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_c"), value))).where("_n = 1")
    return best.select(*keys, F.col(value).alias(out or value))


def ratio_of_sums(top: Column, base: Column) -> Column:
    """sum(top) / sum(base) over rows that have both, null if the base is 0."""
    both = top.isNotNull() & base.isNotNull()
    return F.sum(F.when(both, top)) / F.nullif(F.sum(F.when(both, base)), F.lit(0.0))


def repeat_share(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of events that repeat a label of their key."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg((F.sum(F.greatest(F.col("_c") - 1, F.lit(0))) / F.sum("_c")).alias("repeat_share"))


def bucket_counts(df: DataFrame, bucket: str, labels: list[str]) -> DataFrame:
    """Rows of each configured label, zeros included."""
    spark = df.sparkSession
    every = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "position int, label string")
    counts = df.groupBy(bucket).agg(F.count("*").alias("_c"))
    return every.join(counts, F.col("label") == F.col(bucket), "left").select("position", "label", F.coalesce("_c", F.lit(0)).cast("long").alias("n"))


def prefer_fuller(df: DataFrame, keys: list[str], payload: list[str], order: list) -> DataFrame:
    """Of rows with one key, the one with most payload columns filled, then by order."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in payload), F.lit(0))
    return df.withColumn("_f", filled).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_f"), *order))).where("_n = 1").drop("_n", "_f")


def duration_days(start: Column, end: Column, as_of: Column) -> Column:
    """Days from start to end, an open end meaning as_of, a missing start the end; never below 0."""
    stop = F.coalesce(end, as_of)
    return F.greatest(F.datediff(stop, F.coalesce(start, stop)), F.lit(0))
