import datetime

import pytest
from pyspark.sql import functions as F

from cohortrank.operators import aggregates as A
from cohortrank.operators import joins as J
from cohortrank.operators import merge as M
from cohortrank.operators import windows as N


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_rates_and_low_exposure(spark):
    df = spark.createDataFrame([(90.0, 1.0), (10.0, 1.0), (0.0, 0.0)], "exposure double, goals double")
    out = A.per_exposure(df, ["goals", "absent"])
    assert rows(out.select("goals_rate", "low_exposure", "absent_rate"), "goals_rate") == [(1.0, False, None), (9.0, True, None)]


def test_rolling_form(spark):
    df = spark.createDataFrame([(1, i, g, s) for i, (g, s) in enumerate([(0.5, 2.0), (1.0, 2.5), (1.5, 3.0), (2.0, 3.5)])], "entity int, t int, goals double, shots double")
    long = N.to_long(df, ["entity", "t"], ["goals", "shots"])
    out = {r.metric: r for r in N.rolling_form(long, ["entity", "metric"], [F.desc("t")]).collect()}
    assert out["goals"].roll_3 == 1.5 and out["goals"].period_avg == 1.25 and out["shots"].roll_5 == 2.75
    assert out["goals"].trend_slope_10 == pytest.approx(0.5)
    single = N.rolling_form(long.where("t = 0"), ["entity", "metric"], [F.desc("t")]).first()
    assert single.trend_slope_10 is None and single.roll_10_std == 0


def test_percentiles(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 4.0)], "id int, x double").withColumn("g", F.lit("a"))
    assert [r[0] for r in rows(N.member_percentile(df, ["g"], "x").select("percentile", "id"), "id")] == [25, 75, 75, 100]
    assert [r[0] for r in rows(N.midrank_percentile(df, ["g"], "x").select("percentile", "id"), "id")] == [12.5, 50, 50, 87.5]
    assert [r[0] for r in rows(N.average_rank_pct(df, ["g"], "x").select("rank_pct", "id"), "id")] == [25, 62.5, 62.5, 100]
    probe = spark.createDataFrame([(9, "a", 3.0), (8, "b", 3.0)], "id int, g string, x double")
    assert rows(N.probe_percentile(probe, df, ["g"], "x").select("id", "percentile"), "id") == [(8, None), (9, 75.0)]
    assert N.midrank_percentile(df.limit(2), ["g"], "x").first().percentile is None


def test_bins_follow_linear_edges(spark):
    df = spark.range(13).withColumn("x", F.col("id").cast("double"))
    got = [r[0] for r in rows(N.equal_count_bins(df, ["x"]).select("bin", "id"), "id")]
    assert got == [1, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 10]
    assert N.equal_count_bins(df.limit(1), ["x"]).first().bin == 1


def test_streaks_and_tops(spark):
    df = spark.createDataFrame([("a", 1, 70), ("a", 2, 50), ("a", 3, 60), ("a", 4, 90), ("b", 1, 80), ("c", 1, None)], "k string, t int, v int")
    assert rows(N.trailing_streak(df, ["k"], [F.desc("t")], F.col("v") >= 60), "k") == [("a", 2), ("b", 1), ("c", 0)]
    assert rows(N.top_per_group(df, ["k"], [F.desc("v"), "t"], 1).select("k", "t"), "k") == [("a", 4), ("b", 1), ("c", 1)]


def test_asof_join(spark):
    day = datetime.date
    left = spark.createDataFrame([(1, "a", day(2024, 1, 5)), (2, "a", day(2024, 1, 1)), (3, "b", day(2024, 1, 5)), (4, "a", None)], "id int, k string, t date")
    right = spark.createDataFrame([("a", day(2024, 1, 2), 7), ("a", day(2024, 1, 5), 8), ("a", day(2024, 1, 9), 9)], "k string, d date, v int")
    assert rows(J.asof_join(left, right, ["k"], "t", "d", ["v"]).select("id", "v"), "id") == [(1, 8), (2, None), (3, None), (4, None)]
    assert "Cartesian" not in J.asof_join(left, right, ["k"], "t", "d", ["v"])._jdf.queryExecution().toString()


def test_either_side_join(spark):
    left = spark.createDataFrame([(1, "x", "y"), (2, "y", "x"), (3, "x", "x"), (4, "p", "q")], "id int, home string, away string")
    out = J.either_side_join(left, ["home", "away"], spark.createDataFrame([("x",)], "t string"), "t")
    assert rows(out.select("id", "matched_sides"), "id") == [(1, 1), (2, 1), (3, 2)]


def test_gap_rule_and_tiers(spark):
    df = spark.createDataFrame([("a", "p", 0.90), ("a", "q", 0.89), ("b", "p", 0.99), ("b", "q", 0.98), ("c", "p", 0.90)], "k string, c string, s double")
    assert rows(J.top2_gap(df, "k", "c", "s", 0.85, 0.98, 0.05).select("k", "c", "accepted"), "k") == [("a", "p", False), ("b", "p", True), ("c", "p", True)]
    cand = spark.createDataFrame([(1, 10, True, 0.5), (1, 11, False, 0.9), (2, 12, False, 0.1)], "k int, c int, shirt boolean, sim double")
    out = J.tiered_match(cand, "k", [(F.col("shirt"), 0.95), (F.col("sim") >= 0.85, F.col("sim"))], ["c"])
    assert rows(out.select("k", "c", "tier"), "k") == [(1, 10, 1)]


def test_upsert_and_partial_update(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    payload = spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2), (3, 7.0, 1)], "k int, v double, seq int")
    assert rows(M.upsert(base, payload, ["k"], "seq"), "k") == [(1, "a", 6.0), (2, "b", 2.0), (3, None, 7.0)]
    update = spark.createDataFrame([(2, None, 9.0), (8, "z", 1.0)], "k int, s string, v double")
    assert rows(M.partial_update(base, update, "k"), "k") == [(1, "a", 1.0), (2, "b", 9.0)]


def test_syncs(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, v string")
    assert rows(M.reference_sync(old, new, "k", ["v"]), "k") == [(1, "deactivate"), (2, "same"), (3, "update"), (4, "insert")]
    assert rows(M.drift(old, new).select("k", "drift"), "k", "drift") == [(1, "missing"), (3, "extra"), (3, "missing"), (4, "extra")]
    stages = spark.createDataFrame([(1, "longlist"), (2, "signed"), (3, "longlist")], "k int, stage string")
    assert rows(M.stage_sync(stages, spark.createDataFrame([(3,), (4,)], "k int"), "k"), "k") == [(1, "filtered_out"), (2, "signed"), (3, "longlist"), (4, "longlist")]


def test_small_aggregates(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "y"), ("b", "x"), ("c", None)], "k string, v string")
    assert rows(A.modal(df, ["k"], "v"), "k") == [("a", "x"), ("b", "x")]
    assert rows(A.repeat_share(df, ["k"], "v"), "k") == [("a", pytest.approx(1 / 3)), ("b", 0.0), ("c", 0.0)]
    assert rows(A.bucket_counts(df, "v", ["x", "y", "z"]).select("label", "n"), "label") == [("x", 3), ("y", 2), ("z", 0)]
    day = datetime.date
    spans = spark.createDataFrame([(day(2024, 1, 1), None), (None, None), (day(2024, 1, 9), day(2024, 1, 2))], "a date, b date")
    assert [r[0] for r in spans.select(A.duration_days(F.col("a"), F.col("b"), F.lit("2024-01-11").cast("date"))).collect()] == [10, 0, 0]


def test_results_do_not_depend_on_row_order_or_partitions(spark):
    df = spark.createDataFrame([(i % 5, i, float(i * 37 % 11)) for i in range(100)], "entity int, t int, value double").withColumn("metric", F.lit("m"))
    one = N.rolling_form(df.coalesce(1), ["entity", "metric"], [F.desc("t")])
    many = N.rolling_form(df.orderBy(F.rand(3)).repartition(7), ["entity", "metric"], [F.desc("t")])
    assert rows(one, "entity") == rows(many, "entity")
    assert rows(N.rolling_form(df.where("entity = 3"), ["entity", "metric"], [F.desc("t")]), "entity") == rows(one.where("entity = 3"), "entity")
