"""Upserts, reference syncs and drift reports as joins; the result replaces the target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortrank.operators.joins import latest_per_key


def upsert(base: DataFrame, payload: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """base with payload merged in: of payload rows with one key the last by sequence counts, and only columns that
    the payload has are replaced."""
    last = latest_per_key(payload, keys, [F.desc(sequence)]).drop(sequence)
    changed = [c for c in last.columns if c not in keys]
    new = last.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in changed), F.lit(True).alias("_hit"))
    joined = base.join(new, keys, "full_outer")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in base.columns))


def partial_update(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Non-null fields of update replace base's; keys that base lacks are left out."""
    cols = [c for c in update.columns if c != key]
    new = update.select(key, *(F.col(c).alias(f"_new_{c}") for c in cols))
    return base.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns))


def reference_sync(old: DataFrame, new: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Action for each key: insert, update, deactivate or same."""
    a = old.select(key, F.struct(*payload).alias("_old"))
    b = new.select(key, F.struct(*payload).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "deactivate").when(F.col("_old") != F.col("_new"), "update").otherwise("same")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, marked missing or extra."""
    return expected.exceptAll(actual).withColumn("drift", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("drift", F.lit("extra")))


def stage_sync(existing: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Stage of each key: the chosen are on the longlist, others that were on it are filtered out, the rest stay."""
    joined = existing.select(key, "stage").join(chosen.select(key).distinct().withColumn("_c", F.lit(True)), key, "full_outer")
    return joined.select(key, F.when(F.col("_c"), "longlist").when(F.col("stage") == "longlist", "filtered_out").otherwise(F.col("stage")).alias("stage"))


def crosswalk_backfill(df: DataFrame, walk: DataFrame, on: list[str], target: str, source: str) -> DataFrame:
    """target filled from the cross-walk, never overwritten with null."""
    new = walk.select(*on, F.col(source).alias("_new"))
    return df.join(new, on, "left").withColumn(target, F.coalesce("_new", target)).drop("_new")


def versioned_sync(history: DataFrame, current: DataFrame, name: str, version: str, payload: list[str], day: Column) -> DataFrame:
    """The history of versions after a sync, and the action for each: insert, update, reactivate, close or same.

    history: name, version, payload, is_active, valid_from, valid_to. current holds each version of a name that is live
    once. New versions begin on the day; live ones take the new payload (nulls compare as values) and, if they were
    closed, begin again; versions of a name that current has without them are closed on the day. Names that it lacks
    stay as they are. The same sync again changes nothing.
    """
    keys = [name, version]
    new = current.select(*keys, F.struct(*payload).alias("_new"))
    names = current.select(name).distinct().withColumn("_named", F.lit(True))
    old = history.select(*keys, F.struct(*payload).alias("_old"), "is_active", "valid_from", "valid_to")
    j = old.join(new, keys, "full_outer").join(names, name, "left")
    live, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    closed = ~live & F.coalesce("_named", F.lit(False)) & F.col("is_active")
    action = (
        F.when(~known, "insert").when(live & ~F.col("is_active"), "reactivate").when(live & ~F.col("_new").eqNullSafe(F.col("_old")), "update").when(closed, "close").otherwise("same")
    )
    j = j.withColumn("action", action)
    begins = F.col("action").isin("insert", "reactivate")
    return j.select(
        *keys, *(F.when(live, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in payload), F.when(begins, True).when(F.col("action") == "close", False).otherwise(F.col("is_active")).alias("is_active"),
        F.when(begins, day).otherwise(F.col("valid_from")).alias("valid_from"), F.when(F.col("action") == "close", day).when(begins, None).otherwise(F.col("valid_to")).alias("valid_to"), "action",
    )


def write_sync(synced: DataFrame, path: str) -> dict[str, int]:
    """Write the history without its actions; the counts come from the same job."""
    seen = Observation()
    count = lambda *names: F.count_if(F.col("action").isin(*names))
    counted = synced.observe(seen, count("insert").alias("inserted"), count("update", "reactivate").alias("updated"), count("close").alias("deactivated"))
    counted.drop("action").write.mode("errorifexists").parquet(path)
    return seen.get


def backfill_from_walks(df: DataFrame, walks: list[tuple[DataFrame, list[str], str]], target: str) -> DataFrame:
    """target filled where it is null from several cross-walks (rows, key columns, value column), the first that knows the
    key winning; what is there is never overwritten. Of rows of one key the smallest value counts."""
    out, values = df, [F.col(target)]
    for k, (walk, on, source) in enumerate(walks):
        known = walk.where(F.col(source).isNotNull()).groupBy(*on).agg(F.min(source).alias(f"_walk{k}"))
        out = out.join(known, on, "left")
        values.append(F.col(f"_walk{k}"))
    return out.withColumn(target, F.coalesce(*values)).drop(*(f"_walk{k}" for k in range(len(walks))))
