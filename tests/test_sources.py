import json

import pytest
from pyspark.sql import functions as F

from cohortrank.sources import files, pages, sinks


def test_csv_scan_rejects_and_tables(spark, tmp_path):
    header = "league_id,season,fixture_id,date,home_team,away_team,player_id,player_name,team,position,minutes,seq\n"
    body = "1,2024,10,2024-01-01,A,B,5,Ann,A,D,90,1\n1,2024,10,2024-01-02,A,B,5,Ann,B,D,45,2\n1,2024,11,2024-01-02,A,C,5,Ann,C,D,45,3\n1,2023,12,2023-01-02,A,C,6,Bob,C,D,45,4\n1,2024,13,2024-01-02,A,C,0, ,C,D,1,5\n"
    (tmp_path / "bulk.csv").write_text(header + body)
    df = files.read_csv(spark, str(tmp_path / "bulk.csv"), ["player_id", "fixture_id"], periods=["2024"])
    assert df.count() == 4
    good, bad = files.split_rejects(df, ["player_id"], ["player_name"])
    assert good.count() == 3 and bad.count() == 1
    units, entities, facts = files.three_tables(good.withColumn("seq", F.col("seq").cast("int")))
    assert units.count() == 2 and facts.count() == 3 and entities.first().team == "C"
    with pytest.raises(files.MissingColumns):
        files.read_csv(spark, str(tmp_path / "bulk.csv"), ["absent"])


def test_single_rows_and_folders(spark, tmp_path):
    for name, rows in (("a", "x,1\n"), ("b", "x,1\ny,2\n")):
        (tmp_path / f"{name}.csv").write_text("player,metric\n" + rows)
    out = {r.file[-5:]: r for r in files.single_row(spark.read.option("header", True).csv(str(tmp_path))).collect()}
    assert out["a.csv"].payload == {"player": "x", "metric": "1"} and out["b.csv"].payload is None and "found 2" in out["b.csv"].error
    df = spark.createDataFrame([("p", 1.0, None, 90, 1), ("p", None, None, 180, 2)], "name string, a double, b double, minutes int, n int")
    assert files.merge_cohort_files(df, ["name"], "minutes", "n").first().minutes == 90
    path = spark.createDataFrame([("/d/Top League/a.csv",), ("/d/other/a.csv",)], "p string")
    assert [r[0] for r in path.select(files.cohort_of_path(F.col("p"), {"top league": 3})).collect()] == [3, None]


def test_json_payloads(spark):
    fixture = lambda i, s, home: {"fixture": {"id": i, "date": "2024-01-01", "status": {"short": s}}, "league": {"id": 1, "season": 2024}, "teams": {"home": {"name": home}, "away": {"name": "B"}}}
    landed = spark.createDataFrame([(json.dumps([fixture(1, "FT", "A"), fixture(2, "NS", "A")]), 1), (json.dumps([fixture(1, "PEN", "Z")]), 2)], "body string, seq int")
    units = files.completed_units(landed)
    assert [(r.fixture_id, r.home_team, r.season) for r in units.collect()] == [(1, "Z", "2024")]
    stats = [{"team": {"name": "Z"}, "players": [{"player": {"id": 7, "name": "n"}, "statistics": [{"games": {"minutes": 90, "rating": "7.5"}, "passes": {"total": 5, "accuracy": "78%"}}, {}]}, {"player": {"id": 8}, "statistics": []}]}]
    facts = files.unit_facts(spark.createDataFrame([(1, json.dumps(stats))], "fixture_id int, body string"), units).orderBy("player_id").collect()
    assert facts[0].is_home and facts[0].pass_accuracy == 78.0 and facts[0].rating == 7.5 and facts[1].minutes is None
    team = [{"team": {"name": "Z"}, "statistics": [{"type": " Total Shots", "value": "4"}, {"type": "xG", "value": "1.2"}, {"type": "Ball Possession", "value": "60%"}]}]
    row = files.team_statistics(spark.createDataFrame([(1, json.dumps(team))], "fixture_id int, body string")).first()
    assert (row.shots_total, row.possession, row.expected_goals) == (4.0, 60.0, 1.2)
    line = [{"team": {"name": "Z"}, "startXI": [{"player": {"id": 1, "grid": "1:1"}}], "substitutes": [{"player": {"id": 2}}]}]
    assert [(r.player_id, r.is_starter) for r in files.lineups(spark.createDataFrame([(1, json.dumps(line))], "fixture_id int, body string")).orderBy("player_id").collect()] == [(1, True), (2, False)]
    table = [[{"rank": 1, "team": {"name": "A"}, "points": 9}], [{"rank": 1, "team": {"name": "B"}, "points": 3}]]
    assert files.standings(spark.createDataFrame([(4, json.dumps(table))], "league_id int, body string"), "2024-02-01").count() == 2


def test_rename_cast(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", "1")], "a string, b string")
    out = files.rename_cast(df, {"id": ("a", "int"), "v": ("b", "double"), "none": ("c", "string")}, ["id"])
    assert [tuple(r) for r in out.collect()] == [(1, 2.5, None)]


def test_pages(spark):
    html = "<html><title>T</title><script>var series=[{\"x\":1704067200000,\"y\":2.5}];</script><!-- <table><tr><th colspan=2>G</th></tr><tr><td><a href='/p'>Ann</a></td><td>1&amp;2</td></tr><tr><th colspan=2>G</th></tr></table> --><p>a <b>b</b></p>"
    df = spark.createDataFrame([("u", html), ("n", None)], "url string, html string")
    assert [(r.row, r.cells, r.first_link) for r in pages.table_rows(df).orderBy("row").collect()] == [(0, ["G", "G"], None), (1, ["Ann", "1&2"], "/p")]
    assert [(r.href, r.label) for r in pages.links(df).collect()] == [("/p", "Ann")]
    assert [(r.tag, r.text) for r in pages.text_blocks(df).orderBy("row").collect()] == [("title", "T"), ("p", "a b")]
    row = files.embedded_series(df).first()
    assert str(row.day) == "2024-01-01" and row.value == 2.5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "brief_id int, v string")
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    sinks.write_rejects(df, str(tmp_path / "rejects"), "t1")
    sinks.merge_table(df, spark.createDataFrame([(1, "b", 1)], "brief_id int, v string, seq int"), ["brief_id"], "seq", str(tmp_path / "merged"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 and spark.read.parquet(str(tmp_path / "merged")).first().v == "b"
    assert spark.read.option("header", True).csv(str(tmp_path / "rejects")).count() == 1


def test_reference_files_and_header_names(spark, tmp_path):
    from cohortrank.sources import files, payloads

    (tmp_path / "levels.json").write_text('[\n {"cohort": 1, "level": 2},\n {"cohort": 2, "level": 3}\n]')
    df = payloads.reference_json(spark, str(tmp_path / "levels.json"), ["cohort", "level"])
    assert sorted((r.cohort, r.level) for r in df.collect()) == [(1, 2), (2, 3)]
    with pytest.raises(files.MissingColumns):
        payloads.reference_json(spark, str(tmp_path / "levels.json"), ["name"])
    assert payloads.plain_names(["  Pass %", ("Unnamed: 0_level_0", "Squad"), ("Per 90 Minutes", "xG+xAG"), "a/b__c"]) == ["pass_pct", "squad", "per_90_minutes_xg_xag", "a_b_c"]


def test_payloads_with_holes(spark):
    from cohortrank.sources import payloads

    df = spark.createDataFrame([(1, None), (2, "not json"), (3, "[]"), (4, '[{"player":{"id":"7","birth":{"date":"soon"}}},{"player":{"id":null}}]')], "fixture_id int, body string")
    assert [(r.player_id, r.birth_date, r.current_team) for r in payloads.bios(df).collect()] == [(7, None, None)]
    assert payloads.transfers(df).count() == 0
    assert [(r.fixture_id, r.player_id) for r in payloads.unit_events(df).collect() if r.player_id] == [(4, 7)]


def test_cells_that_span_rows_and_columns(spark):
    html = (
        "<table><tr><th rowspan=2>name</th><th colspan=2>goals</th></tr><tr><th>home</th><th>away</th></tr>"
        "<tr><td rowspan='2'>Ann</td><td>1</td><td rowspan=0>x</td></tr><tr><td>2</td></tr><tr><td>Bo</td><td>3</td></tr><tr></tr></table>"
        "<table><tr><td colspan=150>w</td></tr><tr><td colspan='\u00b2' rowspan='-1'>odd</td></tr></table>"
    )
    out = pages.table_rows(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).orderBy("table", "row").collect()
    assert [r.cells for r in out if r.table == 0] == [["name", "goals", "goals"], ["name", "home", "away"], ["Ann", "1", "x"], ["Ann", "2", "x"], ["Bo", "3", "x"]]
    assert [len(r.cells) for r in out if r.table == 1] == [150, 1]
