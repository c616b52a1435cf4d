import datetime
import random

from pyspark.sql import functions as F

from cohortrank.operators import windows
from cohortrank.streaming import jobs

SCHEMA = "k long, unit long, ts timestamp, v double"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_upsert_over_two_arrivals(spark, tmp_path):
    src, target, checkpoint = (str(tmp_path / x) for x in ("src", "target", "checkpoint"))
    order = [F.desc("ts"), F.desc("unit")]
    for rows in ([(1, 1, at(1), 1.0), (1, 2, at(3), 2.0), (2, 3, at(1), 3.0)], [(1, 4, at(2), 9.0), (2, 5, at(5), 8.0)]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(src)
        jobs.incremental_upsert(stream(spark, src), target, ["k"], order, checkpoint, "ts")
    assert [(r.k, r.unit) for r in jobs.latest(spark, target, ["k"], order).orderBy("k").collect()] == [(1, 2), (2, 5)]


def test_window_counts_equal_the_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(i % 3, i, at(i % 50), 1.0) for i in range(200)], SCHEMA).write.parquet(src)
    counts = jobs.window_counts(stream(spark, src), "ts", ["k"], "10 minutes", "1 minute")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("window_test").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.w.start, r.k): r.n for r in spark.table("window_test").collect()}
    want = {(r.w.start, r.k): r.n for r in spark.read.parquet(src).groupBy(F.window("ts", "10 minutes").alias("w"), "k").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_streaks_over_two_batches(spark, tmp_path):
    src, checkpoint = str(tmp_path / "src"), str(tmp_path / "checkpoint")
    for n, rows in enumerate(([(1, 1, at(1), 70.0), (1, 2, at(2), 80.0), (2, 3, at(1), 10.0)], [(1, 4, at(3), 90.0), (2, 5, at(2), 60.0), (3, 6, at(1), None)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        out = jobs.streaks(stream(spark, src), "k", "ts", "v", 60.0).writeStream.outputMode("update")
        q = out.foreachBatch(lambda df, i, n=n: df.write.mode("overwrite").parquet(f"{src}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    last = {r.k: r.streak for r in spark.read.parquet(f"{src}-0").unionByName(spark.read.parquet(f"{src}-1")).orderBy("last").collect()}
    assert last == {1: 3, 2: 1, 3: 0}


def kept(spark, tmp_path, batches, stretch="10 minutes"):
    """Streaks after rows have arrived in these batches."""
    src, target, checkpoint = (str(tmp_path / x) for x in ("src", "runs", "checkpoint"))
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(src)
        jobs.keep_runs(stream(spark, src), target, "k", "ts", "unit", "v", 60.0, checkpoint, stretch)
    return {r.k: r.streak for r in jobs.runs(spark, target, "k").collect()}


def test_runs_equal_the_batch_over_any_split(spark, tmp_path):
    rng = random.Random(7)
    rows = [(1 if i % 3 == 0 else i % 40, i, at(rng.randrange(60)), rng.choice([10.0, 61.0, 75.0, 60.0, 90.0, 99.0, None])) for i in range(600)]
    rows += [(50, 1000 + i, at(i % 60), 80.0) for i in range(150)] + [(51, 2000, at(5), 1.0)]
    rng.shuffle(rows)  # so most rows are late, and breaks fall into what earlier batches counted
    cuts = sorted(rng.sample(range(len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    want = windows.trailing_streak(spark.createDataFrame(rows, SCHEMA), ["k"], [F.desc("ts"), F.desc("unit")], F.col("v") >= 60)
    want = {r.k: r.streak for r in want.collect()}
    assert want[50] == 150 and want[51] == 0 and len(set(want.values())) > 3
    assert kept(spark, tmp_path / "four", batches) == want
    assert kept(spark, tmp_path / "one", [rows], "1 day") == want


def test_runs_of_nothing_and_of_rows_without_key_or_time(spark, tmp_path):
    assert kept(spark, tmp_path / "empty", [[]]) == {}
    rows = [(None, 1, at(1), 70.0), (1, 2, None, 70.0), (1, 3, at(2), 70.0), (1, 3, at(2), 70.0), (2, 4, at(2), None)]
    assert kept(spark, tmp_path / "odd", [rows]) == {1: 2, 2: 0}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    rows = [(1, i, at(i), 70.0) for i in range(5)]
    assert kept(spark, tmp_path, [rows]) == {1: 5}
    src, target = str(tmp_path / "src"), str(tmp_path / "runs")
    jobs.keep_runs(stream(spark, src), target, "k", "ts", "unit", "v", 60.0, str(tmp_path / "lost"), "10 minutes")  # its checkpoint was lost
    assert {r.k: r.streak for r in jobs.runs(spark, target, "k").collect()} == {1: 5}
