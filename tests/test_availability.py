import datetime as dt
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortrank.operators import joins as J
from cohortrank.operators.joins import count_within
from cohortrank.plans import availability as P
from cohortrank.queries import oracle_sql, queries

DAY = dt.date(2026, 3, 12)


def frames(spark, spans=(), absences=(), changes=()):
    """Four units of one team in three periods each; entity 1 starts some of them."""
    schedule, matches = [], []
    for p, period in enumerate(("2024", "2025", "2026")):
        for k in range(4):
            unit, ts = p * 10 + k, dt.datetime(2024 + p, 1, 5 + k * 7)
            schedule += [(unit, period, "A", ts.date()), (unit, period, "B", ts.date())]
            if k < 3 or p > 0:
                matches.append((1, unit, period, ts, "A" if k else None, 90 if k else 30, k == 0 and p == 0, "M"))
    m = spark.createDataFrame(matches, "entity long, unit long, period string, ts timestamp, team string, exposure int, substitute boolean, label string")
    s = spark.createDataFrame(schedule, "unit long, period string, team string, day date")
    return (
        m, s, spark.createDataFrame(list(spans), "entity long, kind string, start_day date, end_day date"), spark.createDataFrame(list(absences), "entity long, day date"),
        spark.createDataFrame(list(changes), "entity long, unit long, event string, elapsed int"),
    )


def test_features_of_one_entity(spark):
    spans = [(1, "Hamstring", dt.date(2025, 3, 1), dt.date(2025, 3, 11)), (1, "hamstring ", dt.date(2026, 3, 2), None), (1, None, None, dt.date(2024, 6, 1)), (1, "Knock", dt.date(2020, 1, 1), dt.date(2020, 2, 1)), (2, "Calf", DAY, DAY)]
    changes = [(1, 20, "Substitution 1", 70), (1, 21, "subst", 85), (1, 22, "SUBST", None), (1, 23, "card", 10)]
    r = P.features(*frames(spark, spans, [(1, dt.date(2026, 1, 1)), (1, None)], changes), F.lit(DAY)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.rate, round(r.rate_3, 6), r.episodes, r.muscle, r.max_days, r.days_since) == (1.0, round((0.5 + 1 + 1) / 3, 6), 3, 2, 10, (DAY - dt.date(2026, 1, 1)).days)
    assert round(r.mean_days, 6) == round((10 + 10 + 0) / 3, 6) and r.repeat_share == 0.5 and r.continuity == 3 and r.taken_off == 1 / 10


def test_features_without_history(spark):
    r = P.features(*frames(spark), F.lit(DAY)).first()
    assert (r.episodes, r.muscle, r.mean_days, r.days_since, r.repeat_share, r.taken_off) == (0, 0, None, None, None, 0.0)


def test_units_missed_in_spans(spark):
    spans = [(1, "a", dt.date(2023, 1, 1), None), (1, "a", dt.date(2023, 1, 1), None), (1, "b", None, dt.date(2024, 1, 26)), (1, "c", dt.date(2024, 1, 27), dt.date(2024, 1, 1)), (9, "d", dt.date(2020, 1, 1), None)]
    m, s, spans, *_ = frames(spark, spans)
    got = sorted((r.entity, r.kind, r.missed) for r in P.units_missed(spans, m, s, F.lit(DAY)).collect())
    assert got == [(1, "a", 1), (1, "a", 1), (1, "b", 1), (1, "c", 0), (9, "d", 0)]


@pytest.mark.parametrize("width", [1, 32])
def test_count_within_equals_all_pairs(spark, width):
    rng, base = random.Random(width), dt.date(2020, 1, 1)
    day = lambda: base + dt.timedelta(rng.randint(-40, 1500))
    spans = [(i, rng.choice("abc"), day(), day() + dt.timedelta(rng.choice([0, 3, 2000]))) for i in range(80)] + [(80, "a", None, base), (81, None, base, base)]
    points = [(rng.choice("abcd"), day()) for _ in range(400)] + [("a", None), (None, base)]
    out = count_within(spark.createDataFrame(spans, "id long, k string, a date, b date"), spark.createDataFrame(points, "k string, at date"), ["id"], ["k"], "a", "b", "at", "n", width)
    want = {i: sum(1 for p, at in points if p and p == k and at and a and a <= at <= b) for i, k, a, b in spans}
    assert {r.id: r.n for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_training_rows_leave_out_what_comes_later(spark):
    late = [(1, "Calf", dt.date(2025, 6, 1), dt.date(2025, 7, 1)), (1, "Calf", dt.date(2024, 2, 1), None)]
    m, s, spans, absences, _ = frames(spark, late)
    born = spark.createDataFrame([(1, dt.date(2000, 12, 31))], "entity long, born date")
    every = {r.period: r for r in P.training_rows(m, s, spans, absences, born, least_units=3).collect()}
    before = {r.period: r for r in P.training_rows(m, s, spans, absences, born, least_units=3, before_ref=True).collect()}
    assert sorted(every) == ["2024", "2025"] and [every["2024"].episodes, before["2024"].episodes, before["2025"].episodes] == [2, 1, 2]
    assert (before["2024"].age, before["2024"].target, before["2024"].position_group, round(before["2024"].rate, 6)) == (24.0, 1, "M", round(2 / 3, 6))
    assert before["2024"].max_days == 334


def test_threshold_queries_are_stable(spark):
    """One answer whatever the order of summation: over partition counts here and thread counts there."""
    path, name = "/root/testdata/sf0.001", "decorate_predictions"
    answers = set()
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 7, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            answers.add(str(sorted((r.entity, r.board, r.tier, r.strengths) for r in queries()[name](spark, path).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    for n in (1, 2, 4, 8):
        con = duckdb.connect(config={"threads": n})
        for t in ("orders", "lineitem", "customer"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
        answers.add(str(sorted(con.execute(f"SELECT entity, board, tier, strengths FROM ({oracle_sql()[name]})").fetchall())))
    assert len(answers) == 1


@pytest.mark.parametrize("width, few", [(1, 50_000), (32, 50_000), (32, 0)])
def test_count_within_held_equals_all_pairs(spark, monkeypatch, width, few):
    monkeypatch.setattr(J, "FEW_STRETCHES", few)
    rng, base = random.Random(width + few), dt.date(2020, 1, 1)
    day = lambda: base + dt.timedelta(rng.randint(-40, 1500))
    spans = [(i, rng.choice([1, 2, 3, None]), f"s{i}", day(), day() + dt.timedelta(rng.choice([0, 3, 2000]))) for i in range(80)]
    spans += [(80, 1, "x", None, base), (81, 1, "y", base, None), (82, 9, "z", base, base), spans[0], spans[0]]
    held = [(1, "a"), (1, "b"), (2, "b"), (2, "d"), (3, "none"), (4, "a"), (None, "a")]
    points = [(rng.choice("abc"), day()) for _ in range(400)] + [("d", base), ("a", None), (None, base)]
    out = J.count_within_held(
        spark.createDataFrame(spans, "id long, o int, text string, a date, b date"), "o", spark.createDataFrame(held, "o int, k string"), spark.createDataFrame(points, "k string, at date"), ["k"], "a", "b", "at", "n", width)
    want = [(*s, sum(1 for k, at in points for o, h in held if None not in (o, at, s[3], s[4]) and o == s[1] and h == k and s[3] <= at <= s[4])) for s in spans]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert sum(w[-1] for w in want) > 1000


def test_long_spans_are_shuffled_as_a_row_each(spark):
    """2000 entities, 30 spans of ten years each, a team in each of ten periods: no row for each span, team and stretch."""
    def written():
        time.sleep(1)  # the status store lags
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    day = lambda c: F.date_add(F.lit(dt.date(2010, 1, 1)), c.cast("int"))
    period = F.lpad(F.col("p").cast("string"), 4, "0").alias("period")
    matches = spark.range(2000).select(F.col("id").alias("entity"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("p")).select("entity", (F.col("entity") % 50 * 10 + F.col("p")).alias("unit"), period, F.lit(dt.datetime(2010, 1, 1)).alias("ts"), (F.col("entity") % 50).cast("string").alias("team"), F.lit(90).alias("exposure"))
    schedule = spark.range(500).withColumn("p", F.col("id") % 10).select(F.col("id").alias("unit"), period, F.floor(F.col("id") / 10).cast("string").alias("team"), day(F.col("p") * 365).alias("day"))
    spans = spark.range(60_000).select((F.col("id") % 2000).alias("entity"), F.lit("x").alias("kind"), day(F.col("id") % 365).alias("start_day"), day(F.col("id") % 365 + 3650).alias("end_day"))
    began = written()
    r = P.units_missed(spans, matches, schedule, F.lit(DAY)).agg(F.count("*").alias("n"), F.min("missed").alias("a"), F.max("missed").alias("b")).first()
    assert (r.n, r.a, r.b) == (60_000, 0, 0)
    assert written() - began < 4_000_000
