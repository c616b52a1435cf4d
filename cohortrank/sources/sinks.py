"""Writing results: appended logs, rejects, and tables replaced after a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrank.operators.merge import upsert


def append_log(df: DataFrame, path: str, partition: str = "brief_id") -> None:
    df.write.mode("append").partitionBy(partition).parquet(path)


def write_rejects(df: DataFrame, path: str, stamp: str) -> None:
    """Unmatched rows as CSV in a folder of the run's time stamp."""
    df.withColumn("run", F.lit(stamp)).write.option("header", True).csv(f"{path}/run={stamp}")


def merge_table(base: DataFrame, payload: DataFrame, keys: list[str], sequence: str, path: str) -> None:
    """The merged table, written beside the old one; the caller swaps the paths once it is complete."""
    upsert(base, payload, keys, sequence).write.parquet(path)
