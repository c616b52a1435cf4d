"""Helpers that the training-data operators share: scratch tables and global order."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The scratch folder that driver and executors share.

    It is what the cluster names in spark.checkpoint.dir. Only where that is unset, as in local tests,
    a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder, with the writer's options, and read it back: lineage ends there, and
    a lost executor costs no recomputation. The table lives as long as the shared folder keeps it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes and rows of a slice at most; a longer row is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and bytes, so that little of a batch is held as Python objects at once."""

    def halves(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if part.num_rows < 2 or part.nbytes <= size:
            yield part
        else:
            middle = part.num_rows // 2
            yield from halves(part.slice(0, middle))
            yield from halves(part.slice(middle))

    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield from halves(batch.slice(at, rows))
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and stages of other kinds follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small_batches(df: DataFrame) -> None:
    """Let Arrow batches hold at most SLICE_ROWS rows in df's session, so that long texts fill neither the buffers of the
    JVM nor those of a worker. A lower setting stays as it is."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= SLICE_ROWS:
        conf.set(name, SLICE_ROWS)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of the filter that thins out rows before they are joined by a key: 8 MB, however many there are.
FILTER_BITS = 1 << 26


def filtered(rows: DataFrame, keys: DataFrame, column: str, rest: bool = False) -> DataFrame:
    """rows without most of those whose column is not in keys, or with rest the rows that this leaves out.

    A bitmap of hashed keys decides, of fixed size: it may let others pass but never leaves out a row in keys."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("long")
    bucket, bits = free_name(rows, "_bucket"), free_name(rows, "_bits")
    built = keys.select(at(column).alias("h")).groupBy(F.bitmap_bucket_number("h").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias(bits))
    place = F.bitmap_bit_position(at(column))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    # the bit is a condition of the join, which so makes no row but those that stay
    return rows.join(F.broadcast(built), (F.bitmap_bucket_number(at(column)) == F.col(bucket)) & hit, "left_anti" if rest else "left_semi")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_global_order(df: DataFrame, keys: list, weight: str) -> tuple[DataFrame, int, int]:
    """Add _index (0, 1, 2... in the order of keys) and _before (sum of weight over all earlier rows).

    Range partitions are sorted on their own; the driver sees one total per partition and hands each
    partition the sum of those before it. No task holds more than its range. Also returns the number of rows
    and the sum of weight. Rows that tie on all keys take any order among themselves.
    """
    spark = df.sparkSession
    shared_dir(spark)
    held = (
        df.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    totals = held.groupBy("_part").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()
    base, rows, total = {}, 0, 0
    for r in sorted(totals, key=lambda r: r["_part"]):
        base[r["_part"]] = (rows, total)
        rows, total = rows + r["n"], total + r["w"]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for pdf in batches:
            if not len(pdf):
                continue
            index, before = at or base[int(pdf["_part"].iloc[0])]
            w = pdf[weight].to_numpy(np.int64)
            upto = before + np.cumsum(w)
            yield pdf.drop(columns="_part").assign(_index=index + np.arange(len(pdf)), _before=upto - w)
            at = index + len(pdf), int(upto[-1])

    schema = T.StructType(
        [f for f in held.schema.fields if f.name != "_part"]
        + [T.StructField("_index", T.LongType()), T.StructField("_before", T.LongType())]
    )
    return held.mapInPandas(add, schema), rows, total
