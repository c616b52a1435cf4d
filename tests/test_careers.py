import datetime as dt

from pyspark.sql import functions as F

from cohortrank.operators import merge as M
from cohortrank.plans import careers as P

D = dt.date


def test_career_of_one_entity(spark):
    matches = [(1, p, dt.datetime(int(p), m, 1), c, t, pos, 90, g, None) for p, m, c, t, pos, g in [
        ("2022", 3, 1, "A", "CB", 1.0), ("2023", 3, 2, "B", "CB", 2.0), ("2024", 3, 2, "B", " cb", 4.0), ("2024", 4, 2, "B", "ST", 4.0), ("2025", 3, 9, "B", "CB", 3.0)]] + [(2, "2025", dt.datetime(2025, 1, 1), 1, "Z", None, 90, 1.0, None), (1, "2026", dt.datetime(2026, 1, 1), 5, "Q", "ST", 0, 9.0, None)]
    m = spark.createDataFrame(matches, "entity long, period string, ts timestamp, cohort int, team string, position string, exposure int, goals double, saves double")
    transfers = spark.createDataFrame([(1, "On loan", "B", "A"), (1, None, "", None), (1, "Free", "C", "B"), (3, "Loan", "X", "Y")], "entity long, kind string, team_in string, team_out string")
    entities = spark.createDataFrame([(1, D(1996, 3, 1), "B"), (2, None, None)], "entity long, born date, team string")
    leagues = spark.createDataFrame([(1, 1, "E"), (2, 2, "E")], "cohort int, tier int, country string")
    got = {r.entity: r for r in P.features(m, transfers, entities, leagues, ["goals", "saves"], F.lit("2026-03-01").cast("date"), {"cb": "back", "st": "front"}, {"back": (26, 31), "front": (24, 28)}).collect()}
    assert sorted(got) == [1, 2]
    r = got[1]
    assert [(h.period, h.tier) for h in r.tier_history] == [("2022", 1), ("2023", 2), ("2024", 2), ("2025", None)]
    assert (r.loans, r.teams, r.countries, r.age_first, r.periods_at_team, r.change, r.curve) == (1, 3, 1, 26.0, 3, -1.0, "peak")
    r = got[2]
    assert (r.loans, r.teams, r.countries, r.age_first, r.periods_at_team, r.change, r.curve) == (0, 0, 1, None, 0, None, None)


def test_stints_are_islands(spark):
    rows = [(1, f"{y}", t) for y, t in zip(range(2018, 2026), ["A", "A", "B", "A", "A", None, "A", "B"], strict=True)] + [(2, "2020", "B")]
    got = sorted((r.entity, r.first, r.last, r.team, r.n) for r in P.stints(spark.createDataFrame(rows, "entity long, period string, team string")).collect())
    assert got == [(1, "2018", "2019", "A", 2), (1, "2020", "2020", "B", 1), (1, "2021", "2022", "A", 2), (1, "2024", "2024", "A", 1), (1, "2025", "2025", "B", 1), (2, "2020", "2020", "B", 1)]


def test_sync_of_versions(spark, tmp_path):
    day = F.lit("2026-01-01").cast("date")
    old = [("a", "1", "x", True, D(2020, 1, 1), None), ("a", "2", "y", False, D(2020, 1, 1), D(2021, 1, 1)), ("b", "1", "x", True, D(2020, 1, 1), None), ("c", "1", None, True, D(2020, 1, 1), None), ("d", "1", "x", False, D(2020, 1, 1), D(2021, 1, 1))]
    history = spark.createDataFrame(old, "name string, version string, metrics string, is_active boolean, valid_from date, valid_to date")
    current = spark.createDataFrame([("a", "2", "y"), ("b", "1", "z"), ("b", "2", "w"), ("c", "1", None)], "name string, version string, metrics string")
    synced = M.versioned_sync(history, current, "name", "version", ["metrics"], day)
    new = D(2026, 1, 1)
    assert sorted(tuple(r) for r in synced.collect()) == [
        ("a", "1", "x", False, D(2020, 1, 1), new, "close"), ("a", "2", "y", True, new, None, "reactivate"), ("b", "1", "z", True, D(2020, 1, 1), None, "update"), ("b", "2", "w", True, new, None, "insert"),
        ("c", "1", None, True, D(2020, 1, 1), None, "same"), ("d", "1", "x", False, D(2020, 1, 1), D(2021, 1, 1), "same"),
    ]
    path = str(tmp_path / "history")
    assert M.write_sync(synced, path) == {"inserted": 1, "updated": 2, "deactivated": 1}
    again = M.versioned_sync(spark.read.parquet(path), current, "name", "version", ["metrics"], F.lit("2027-01-01").cast("date"))
    assert {r.action for r in again.collect()} == {"same"} and again.drop("action").exceptAll(spark.read.parquet(path)).count() == 0
    assert M.write_sync(again, str(tmp_path / "again")) == {"inserted": 0, "updated": 0, "deactivated": 0}


def test_two_walks_never_overwrite(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", 9), (4, None, None), (5, "e", None)], "id int, k string, t int")
    one = spark.createDataFrame([("a", 7), ("a", 5), ("b", None), ("c", 1)], "k string, v int")
    two = spark.createDataFrame([("a", 3), ("b", 4)], "k string, v int")
    got = {r.id: r.t for r in M.backfill_from_walks(df, [(one, ["k"], "v"), (two, ["k"], "v")], "t").collect()}
    assert got == {1: 5, 2: 4, 3: 9, 4: None, 5: None}
