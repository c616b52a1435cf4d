"""Window operators: form, trend, percentiles, bins, streaks and tops, over all entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.operators.ranks import with_ranks


def to_long(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """ids, metric, value: one row for each metric that is not null."""
    return df.unpivot(ids, metrics, "metric", "value").where("value IS NOT NULL")


def rolling_form(long: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Per key: means of the last 3, 5 and 10 values and of all, spread and variation of the last 10, slopes of the
    last 10 and of all. `order` puts the latest first; slopes run forward in time."""
    ranked = long.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    last = lambda k, x: F.when(F.col("_n") <= k, x)
    value, at = F.col("value"), -F.col("_n").cast("double")
    out = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(F.avg(last(k, value)).alias(f"roll_{k}") for k in (3, 5, 10)),
        F.avg(value).alias("period_avg"),
        F.stddev_pop(last(10, value)).alias("roll_10_std"),
        F.regr_slope(last(10, value), last(10, at)).alias("trend_slope_10"),
        F.regr_slope(value, at).alias("trend_slope_all"),
    )
    enough = lambda c: F.when(F.col("n") >= 2, F.col(c))
    return out.withColumns({"roll_10_cv": F.when(F.col("roll_10") != 0, F.col("roll_10_std") / F.col("roll_10")), "trend_slope_10": enough("trend_slope_10"), "trend_slope_all": enough("trend_slope_all")})


def member_percentile(df: DataFrame, peers: list[str], value: str, out: str = "percentile", wide: bool = False) -> DataFrame:
    """Share of peers (the row itself included) that do not exceed the row, times 100. A group is sorted in one task; with
    wide, for groups that outgrow that, it is spread over many."""
    if wide:
        return with_ranks(df, peers, [value]).withColumn(out, 100.0 * (F.col("_below") + F.col("_ties")) / F.col("_n")).drop("_below", "_ties", "_n")
    return df.withColumn(out, F.cume_dist().over(W.partitionBy(*peers).orderBy(value)) * 100)


def probe_percentile(probes: DataFrame, members: DataFrame, peers: list[str], value: str, out: str = "percentile") -> DataFrame:
    """The same for rows that are not members themselves; null where there are no peers. One sort per peer group."""
    both = probes.withColumn("_w", F.lit(0)).unionByName(members.select(*peers, value).withColumn("_w", F.lit(1)), allowMissingColumns=True)
    below = F.sum("_w").over(W.partitionBy(*peers).orderBy(value).rangeBetween(W.unboundedPreceding, 0))
    total = F.sum("_w").over(W.partitionBy(*peers))
    return both.withColumn(out, F.when(total > 0, 100.0 * below / total)).where("_w = 0").drop("_w")


def midrank_percentile(df: DataFrame, peers: list[str], value: str, least: int = 3, out: str = "percentile") -> DataFrame:
    """100 * (number below + number not above) / 2n among non-null values; null below `least` of them. Groups may be of any
    size."""
    ranked = with_ranks(df.where(F.col(value).isNotNull()), peers, [value])
    percent = 100 * (2 * F.col("_below") + F.col("_ties")) / (2.0 * F.col("_n"))
    return ranked.withColumn(out, F.when(F.col("_n") >= least, percent)).drop("_below", "_ties", "_n")


def average_rank_pct(df: DataFrame, peers: list[str], value: str, out: str = "rank_pct") -> DataFrame:
    """100 * rank / n, ties at their mean rank. Groups may be of any size."""
    ranked = with_ranks(df, peers, [value])
    return ranked.withColumn(out, 100 * (F.col("_below") + (F.col("_ties") + 1) / 2.0) / F.col("_n")).drop("_below", "_ties", "_n")


def trailing_streak(df: DataFrame, keys: list[str], order: list, holds) -> DataFrame:
    """Per key, how many of the latest rows in a row hold; `order` puts the latest first."""
    ranked = df.withColumns({"_n": F.row_number().over(W.partitionBy(*keys).orderBy(*order)), "_h": F.coalesce(holds, F.lit(False))})
    return ranked.groupBy(*keys).agg(F.coalesce(F.min(F.when(~F.col("_h"), F.col("_n"))) - 1, F.count("*")).cast("long").alias("streak"))


def equal_count_bins(df: DataFrame, order: list[str], bins: int = 10, peers: list[str] = (), out: str = "bin") -> DataFrame:
    """Bins of near equal count on the rank (by the columns of `order`, ties in any order), edges linear and closed on the
    right. Groups may be of any size; only rows that tie on all of `order` meet in one task."""
    ranked = with_ranks(df, list(peers), order)
    rank = F.col("_below") + F.row_number().over(W.partitionBy(*peers, *order).orderBy(*order))
    q = F.least(F.lit(bins), F.col("_n"))
    return ranked.withColumn("_r", rank).withColumn(out, F.when(F.col("_n") == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("_r") - 1) * q / (F.col("_n") - 1)))).cast("int")).drop("_n", "_r", "_below", "_ties")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key, with their place; Spark limits groups before the shuffle."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)
