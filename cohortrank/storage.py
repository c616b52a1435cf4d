"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir. Only where that is unset and the master is local, as in tests, a
    temporary folder takes its place."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def written_once(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: several parts of a plan read it, one job computes it, and a lost
    executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
