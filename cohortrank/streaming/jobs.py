"""Structured Streaming jobs: incremental upsert, windowed counts and a keyed streak."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortrank.operators.joins import latest_per_key


def incremental_upsert(stream: DataFrame, target: str, keys: list[str], order: list, checkpoint: str, changed_at: str) -> None:
    """Drain what has arrived: each micro-batch's last row per key goes to its own folder of the target, so a batch
    that runs again replaces its own rows. A failure leaves the checkpoint where it was. latest() reads the result."""

    def write(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, target: str, keys: list[str], order: list) -> DataFrame:
    """The last row of each key over all batches."""
    return latest_per_key(spark.read.parquet(target), keys, order)


def window_counts(stream: DataFrame, ts: str, keys: list[str], window: str, lateness: str) -> DataFrame:
    """Rows per key and window; later rows than `lateness` are dropped."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count("*").alias("n"))


def drain_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """Rows of an updating query, each micro-batch in a folder of its own: a batch that runs again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


PARTS = ("breaks", "counts", "rows")


def keep_runs(stream: DataFrame, target: str, key: str, ts: str, unit: str, value: str, least: float, checkpoint: str, stretch: str = "1 day") -> None:
    """Drain what has arrived into summaries that runs() adds up, whatever the order of arrival.

    A row holds if value reaches least (a null does not); rows go by (ts, unit). A micro-batch leaves three tables, each
    in a folder of the batch, so a batch that runs again replaces its own: the last row of each key that breaks a run;
    the rows that hold after it, keys and times only; and how many these are in each key and stretch of time, with the
    first and last of them. Counts and maxima are combined before the shuffle, so a key with a third of all rows lies in
    many tasks, and nothing of a key is held in memory between batches. Rows without key or time take no part.
    """
    place = F.struct(F.col(ts).alias("ts"), F.col(unit).alias("unit"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
            F.col(key).alias("key"), F.window(ts, stretch)["start"].alias("stretch"), place.alias("at"), F.coalesce(F.col(value) >= least, F.lit(False)).alias("holds")
        )

    def write(batch: DataFrame, number: int) -> None:
        def kept(df: DataFrame, part: str) -> DataFrame:
            path = f"{target}/{part}/batch={number}"
            df.write.mode("overwrite").parquet(path)
            return batch.sparkSession.read.schema(df.schema).parquet(path)

        rows = placed(batch)
        breaks = kept(rows.where("not holds").groupBy("key").agg(F.max("at").alias("last")), "breaks")
        # rows before the batch's own last break of their key can never count again
        found = rows.where("holds").join(breaks, "key", "left").where(F.col("last").isNull() | (F.col("at") > F.col("last")))
        held = kept(found.select("key", "stretch", "at"), "rows")
        kept(held.groupBy("key", "stretch").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")), "counts")

    write(stream.sparkSession.createDataFrame([], stream.schema), -1)  # so that runs() finds tables where nothing has arrived
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def runs(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Key and streak: how many of its latest rows hold in a row, over all batches that keep_runs() has drained.

    A stretch of a batch adds its count if it lies after its key's last break and nothing if it lies before; rows are
    read only of the stretches that the break cuts. Sums and maxima do not depend on how rows fell into batches."""
    breaks, counts, rows = (spark.read.parquet(f"{target}/{p}") for p in PARTS)
    last = breaks.groupBy("key").agg(F.max("last").alias("_last"))
    found = counts.join(last, "key", "left")
    whole = found.where(F.col("_last").isNull() | (F.col("first") > F.col("_last"))).select("key", "n")
    cut = found.where((F.col("first") <= F.col("_last")) & (F.col("last") > F.col("_last"))).select("batch", "key", "stretch", "_last")
    inside = rows.join(cut, ["batch", "key", "stretch"]).where(F.col("at") > F.col("_last")).select("key", F.lit(1).cast("long").alias("n"))
    none = last.select("key", F.lit(0).cast("long").alias("n"))
    return whole.unionByName(inside).unionByName(none).groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("streak"))


def streaks(stream: DataFrame, key: str, ts: str, value: str, least: float) -> DataFrame:
    """After each micro-batch, for keys it touched, how many of the latest rows in a row reach `least`. State per key
    is one number and the time of its last row; rows older than that are ignored, so rows must arrive in order.
    keep_runs() takes them in any."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, last = state.get if state.exists else (0, -1)
        held: list[tuple[int, int, bool]] = []
        for rows in batches:  # of a batch only the time, the unit and whether the row holds are kept
            at = rows[ts].astype("int64")
            held += zip(at[at >= last], rows["unit"][at >= last], rows[value][at >= last] >= least, strict=True)
        for t, _, holds in sorted(held):
            streak, last = (streak + 1 if holds else 0), int(t)
        state.update((int(streak), int(last)))
        yield pd.DataFrame({key: [keys[0]], "streak": [int(streak)], "last": [int(last)]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, streak long, last long", "streak long, last long", "update", GroupStateTimeout.NoTimeout)
