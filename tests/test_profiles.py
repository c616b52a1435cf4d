from pyspark.sql import functions as F

from cohortrank.plans import profiles as R

COLUMNS = "entity int, unit int, team string, is_starter boolean, label string, grid string"


def test_usage_of_starters(spark):
    rows = [
        (1, 1, "a", True, "F", "4:1"), (1, 2, "a", True, "F", "4:2"), (1, 3, "a", True, "M", "4:2"), (1, 4, "a", True, "M", "3:4"), (1, 5, "a", True, "D", "3:1"), (1, 6, "a", True, "F", "2:1"), (1, 7, "a", True, None, "4:1"),
        (1, 8, "a", False, "F", "4:1"), (1, 9, "a", None, "F", "4:1"), (1, 10, "a", True, "F", "odd"), (1, 11, "a", True, "M", None), (2, 1, "a", True, None, None), (3, 4, "a", True, "M", "3:2"), (4, 1, "a", False, "F", "4:1"),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    own = {r.entity: tuple(r)[1:] for r in R.usage(df, ["entity"]).collect()}
    assert set(own) == {1, 2, 3} and own[2] == (0, None, None, 0, None, None)
    assert own[1][0] == 8 and own[1][1] == 4 / 8 and own[1][2] == 3 / 8  # F: units 1, 2, 6, 10; M: 3, 4, 11; D: 5
    assert own[1][3:] == (3, 2 / 3, 1 / 3)  # a line of one, F in a line of two; the edge of four; M in a line of two is neither
    shared = {r.entity: tuple(r)[4:] for r in R.usage(df, ["entity"], shared_lines=True).collect()}
    assert own[3][3:] == (0, None, None) and shared[3] == (1, 1.0, 0.0)  # between 1 and 4 of the unit's line
    assert R.usage(df.where("false"), ["entity"]).count() == 0


def test_fail_before_caution_before_pass(spark):
    role = R.Role(180.0, (R.Limit("s", "n", "share of s", least=0.3, most=0.6), R.Limit("t", "m", "share of t", most=0.5, enough=2)))
    rows = [(1, 179.0, 0.25, 5, 0.75, 2), (2, None, 0.25, 4, 0.5, 1), (3, 180.0, 0.6, 5, 0.5, 2), (4, None, 0.7, 9, None, None), (5, 190.0, 0.1 + 0.2, 5, None, 3), (6, 190.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, height double, s double, n int, t double, m int")
    got = {r.k: (r.g.result, r.g.detail) for r in df.select("k", R.role_gate(role).alias("g")).collect()}
    assert got == {
        1: ("fail", "height 179.0 is below 180 ; share of s 0.25 is below 0.30 ; share of t 0.75 is above 0.50"), 2: ("caution", "height is not known ; fewer than 5 n ; fewer than 2 m"), 3: ("pass", ""),
        4: ("fail", "share of s 0.70 is above 0.60"), 5: ("pass", ""), 6: ("caution", "fewer than 5 n ; fewer than 2 m"),
    }
    assert df.select(R.role_gate(R.Role()).alias("g")).select("g.result").distinct().collect() == [("pass",)]


def test_pathways(spark):
    people = spark.createDataFrame([(1, "a", 20, 3), (2, "a", 21, 3), (3, "a", 20, 2), (4, "b", 30, 3), (5, "b", 30, 2), (6, "c", 20, 3), (7, None, 20, 3), (8, "d", 20, 3), (9, "a", None, 3), (10, "e", 20, 3)], "k int, segment string, age int, contract_years int")
    options = spark.createDataFrame([("a", 11, 20), ("b", 24, 20), ("c", None, 20), ("d", 25, 99), ("e", 11, None), (None, 1, 99)], "segment string, option_months int, option_age int")
    out = R.pathways(people, options)
    assert {r.k for r in out.where("pathway = 'fail'").collect()} == {1} and {r.k for r in out.where("pathway_soft = 'exception'").collect()} == {4}
    assert out.count() == 10 and out.columns == [*people.columns, "pathway", "pathway_soft"]
    assert out.select(F.count_if(F.col("pathway").isNull() | F.col("pathway_soft").isNull())).first()[0] == 0
