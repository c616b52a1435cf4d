"""Ranks in groups of any size: counts of distinct values, summed over ranges of them, instead of one sort for each group."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.storage import written_once


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which nulls of the keys are equal."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(renamed, same).drop(*(f"_k_{k}" for k in keys))


def rank_table(df: DataFrame, peers: list[str], order: list[str], counts: list[Column] = ()) -> DataFrame:
    """peers, order, _ties (rows that have these values), _below (rows of the group before them), _n (rows of the group) and
    the given aggregates of the tied rows; nulls come first.

    Distinct values are dealt to ranges of (peers, order), so a large group fills many tasks; each task adds up its own
    range, and a row a group and range carries what lies before it.
    """
    counted = df.groupBy(*peers, *order).agg(F.count("*").alias("_ties"), *counts)
    ranged = written_once(counted.repartitionByRange(*peers, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*peers, "_part").agg(F.sum("_ties").alias("_sum"))
    group = W.partitionBy(*(peers or [F.lit(0)]))  # a row a range
    before = F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select(*peers, "_part", before.alias("_base"), F.sum("_sum").over(group).alias("_n"))
    inside = F.sum("_ties").over(W.partitionBy(*peers, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("_ties")
    return matched(ranged.withColumn("_inside", inside), bases, [*peers, "_part"]).withColumn("_below", F.col("_base") + F.col("_inside")).drop("_base", "_inside", "_part")


def with_ranks(df: DataFrame, peers: list[str], order: list[str]) -> DataFrame:
    """df with _ties, _below and _n of its rows."""
    return matched(df, rank_table(df, peers, order), [*peers, *order])


def exact_percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Percentiles of the non-null values, linear between neighbours as F.percentile gives them, which holds all distinct values
    in one task; here they lie in ranges."""
    ranked = rank_table(df.where(F.col(value).isNotNull()).select(value), [], [value])
    count = F.col("_n") - 1
    wanted = F.array(*(f(F.lit(float(p)) * count).cast("long") for p in shares for f in (F.floor, F.ceil)))
    held = F.filter(wanted, lambda k: (k >= F.col("_below")) & (k < F.col("_below") + F.col("_ties")))
    found = ranked.where(F.size(held) > 0).select(value, "_below", "_ties", "_n").collect()  # two rows a share at most
    out = []
    for p in shares:
        if not found:
            out.append(None)
            continue
        at = p * (found[0]["_n"] - 1)
        low, high = (next(r[value] for r in found if r["_below"] <= k < r["_below"] + r["_ties"]) for k in (math.floor(at), math.ceil(at)))
        out.append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out
