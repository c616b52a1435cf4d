import datetime as dt
import random

from pyspark.sql import functions as F

from cohortrank.operators.joins import asof_many
from cohortrank.plans import training as P

D = dt.date


def moved(spark, shift=0):
    """An entity that changes cohort on the first of 2025; what is known of it is dated that day plus shift."""
    matches = [(1, "2024", "A", "a", 600, 10.0, False), (1, "2025", "B", "b", 900, 20.0, False), (1, "2025", "B", "b", 0, 0.0, True), (2, "2024", "A", "a", 600, 1.0, False), (2, "2025", "A", "a", 600, 1.0, False), (3, "2024", "A", "a", 500, 1.0, False)]
    day = D(2025, 1, 1) + dt.timedelta(shift)
    m = spark.createDataFrame(matches, "entity long, period string, cohort string, team string, exposure int, goals double, substitute boolean")
    places = spark.createDataFrame([("A", "a", day, 3), ("A", "a", D(2024, 1, 1), 9), ("B", "b", day, 5)], "cohort string, team string, day date, position int")
    roles = spark.createDataFrame([(1, day, "striker")], "entity long, day date, role string")
    born = spark.createDataFrame([(1, D(2000, 1, 1))], "entity long, born date")
    return P.projection_rows(m, places, roles, born, ["goals"]).collect()


def test_projection_rows_know_nothing_later_than_their_day(spark):
    now, late = moved(spark), moved(spark, 1)
    assert len(now) == len(late) == 1
    r, s = now[0], late[0]
    assert (r.cohort, r.next_cohort, r.age, r.target_starter) == ("A", "B", 25.0, 0) and (round(r.origin_goals, 6), round(r.target_goals, 6)) == (1.5, 2.0)
    assert (r.role, r.origin_position, r.target_position) == ("striker", 3.0, 5.0)
    assert (s.role, s.origin_position, s.target_position) == ("unknown", 9.0, 12.0)  # one day later: not known yet


def test_fee_rows_know_nothing_later_than_their_day(spark):
    day = D(2025, 6, 1)
    signings = spark.createDataFrame([(1, 7, day, 5.0), (2, 7, day, 0.0), (3, 8, day, 1.0), (4, 9, None, 1.0)], "signing long, entity long, day date, fee double")
    born = spark.createDataFrame([(7, D(2000, 6, 1))], "entity long, born date")
    levels = spark.createDataFrame([(1, 2)], "cohort int, level int")

    def rows(shift):
        at = day + dt.timedelta(shift)
        values = spark.createDataFrame([(7, at, 90.0, D(2026, 6, 1)), (7, D(2020, 1, 1), 10.0, None)], "entity long, day date, value double, contract_end date")
        seasons = spark.createDataFrame([(7, at, 1, "Mid", 900, 10)], "entity long, day date, cohort int, label string, exposure int, goals int")
        roles = spark.createDataFrame([(7, at, "controller")], "entity long, day date, role string")
        return {r.signing: r for r in P.fee_rows(signings, values, seasons, roles, levels, born, {"goals": 0.3}).collect()}

    now, late = rows(0), rows(1)
    assert sorted(now) == sorted(late) == [1, 3]
    assert (now[1].value, now[1].role, now[1].level, now[1].position_group, now[1].age, round(now[1].output, 6), round(now[1].contract_years, 3)) == (90.0, "controller", 2.0, "M", 25.0, 0.3, 0.999)
    assert (late[1].value, late[1].role, late[1].level, late[1].position_group, late[1].output, late[1].contract_years) == (10.0, "unknown", 3.0, "U", 0.0, 0.0)
    assert (now[3].value, now[3].age, now[3].level) == (0.0, 24.0, 3.0)


def test_many_sources_meet_as_one_by_one(spark):
    rng = random.Random(8)
    day = lambda: D(2024, 1, 1) + dt.timedelta(rng.randint(0, 60))
    left = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2]), day() if i % 9 else None) for i in range(120)]
    one = [(rng.choice(["a", "b", None]), day(), i) for i in range(60)]
    two = [(rng.choice(["a", "b"]), rng.choice([1, 2]), day() if i % 7 else None, rng.choice([None, f"v{i}"])) for i in range(60)]
    df = spark.createDataFrame(left, "id long, k string, n int, at date").repartition(4)
    out = asof_many(df, ["id"], "at", {
        "x": (spark.createDataFrame(one, "key string, day date, v long"), ["k"], ["key"], "day"), "y": (spark.createDataFrame(two, "key string, num int, day date, w string"), ["k", "n"], ["key", "num"], "day"),
    })
    got = {r.id: (r.x and r.x.day, r.y and r.y.day) for r in out.collect()}
    for i, k, n, at in left:
        a = max((d for key, d, _ in one if k and key == k and at and d <= at), default=None)
        b = max((d for key, num, d, _ in two if k and key == k and num == n and at and d and d <= at), default=None)
        assert got[i] == (a, b)
    plan = out.select("id", F.col("x.v")).distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
