import csv
import io
import re
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortrank.sources import workbooks as B
from cohortrank.sources.payloads import plain_name

HEADER = ["Id", "Name", "Goals, %", "Goals %", "", "Seen", "Fit"]
ROWS = [
    [1, "Ann <&>", 2.5, 1, " kept ", datetime(2024, 2, 29), True],
    [None] * 7,
    [2, "Ünal\nB", None, 0.1, None, datetime(1900, 3, 1, 12, 30), False],
    [3, "n/a", -1e-05, 7, "x" * 40_000, None, None],
]


def written(path, rows):
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        text = lambda x: "" if x is None else str(x).lower() if isinstance(x, bool) else x.strftime("%Y-%m-%d" if x.hour == 0 else "%Y-%m-%d %H:%M:%S") if isinstance(x, datetime) else str(x)
        csv.writer(f).writerows([HEADER, *([text(x) for x in row] for row in rows)])


def test_workbook_and_csv_of_one_table_are_equal(spark, tmp_path):
    for folder in ("Top League", "deep/Second  league", "unknown"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "Top League" / "a 2024.xlsx").write_bytes(B.pack(HEADER, ROWS))
    written(tmp_path / "deep" / "Second  league" / "a.CSV", ROWS)
    (tmp_path / "unknown" / "a.xlsx").write_bytes(B.pack(HEADER, ROWS))
    (tmp_path / "Top League" / "broken.xlsm").write_bytes(b"PK no workbook")
    (tmp_path / "Top League" / "empty.csv").write_bytes(b"")
    (tmp_path / "Top League" / "notes.txt").write_bytes(b"no export")
    aliases = {"top league": 1, "Second League": 2}
    out = B.read_root(spark, str(tmp_path), aliases).orderBy("path", "row").collect()
    first, second = ([(r.row, r.payload) for r in out if r.cohort_id == c and r.error is None] for c in (1, 2))
    assert first == second and [n for n, _ in first] == [1, 2, 3]
    assert first[0][1] == {"id": "1", "name": "Ann <&>", "goals": "2.5", "goals_1": "1", "unnamed_4": " kept ", "seen": "2024-02-29", "fit": "true"}
    assert first[1][1]["seen"] == "1900-03-01 12:30:00" and first[2][1]["name"] is None and len(first[2][1]["unnamed_4"]) == 40_000
    assert [(r.folder, r.path.rsplit("/", 1)[1], r.payload) for r in out if r.error] == [("Top League", "broken.xlsm", None)]
    assert B.read_root(spark, str(tmp_path), aliases, ["SECOND league"]).select("cohort_id").distinct().collect() == [(2,)]


def test_sheets_as_other_programs_write_them(spark):
    """Cells without a place, rich and inline texts, errors, custom formats, the calendar of 1904, a sheet of another name."""
    sheet = (
        "<row><c t='inlineStr'><is><t>a</t></is></c><c t='s'><v>0</v></c><c t='str'><v>c</v></c></row><row/>"
        "<row><c r='A3' s='1'><v>1.5</v></c><c r='C3' t='e'><v>#REF!</v></c></row><row><c r='B4' s='2'><v>3</v></c><c><v>4</v></c><c><v>beyond</v></c></row><row><c r='A5' s='1'><v>0.25</v></c></row>"
    )
    parts = zipfile.ZipFile(io.BytesIO(B.pack(["x"], [])))
    own = {n: parts.read(n).decode() for n in parts.namelist()}
    own["xl/sheets/one.xml"] = re.sub("<sheetData>.*</sheetData>", f"<sheetData>{sheet}</sheetData>", own.pop("xl/worksheets/sheet1.xml"))
    own["xl/_rels/workbook.xml.rels"] = own["xl/_rels/workbook.xml.rels"].replace("worksheets/sheet1.xml", "/xl/sheets/one.xml")
    own["xl/workbook.xml"] = own["xl/workbook.xml"].replace("<sheets>", "<workbookPr date1904='1'/><sheets>")
    own["xl/sharedStrings.xml"] = re.sub("<si>.*</si>", "<si><r><t>b</t></r><r><t>b</t></r><rPh><t>read</t></rPh></si>", own["xl/sharedStrings.xml"])
    own["xl/styles.xml"] = re.sub("<fonts", "<numFmts><numFmt numFmtId='164' formatCode='dd/mm'/><numFmt numFmtId='165' formatCode='0.0\"days\"[Red]'/></numFmts><fonts", own["xl/styles.xml"]).replace("</cellXfs>", "<xf numFmtId='165'/></cellXfs>").replace("numFmtId=\"14\"", "numFmtId='164'")
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for n, t in own.items():
            z.writestr(n, t)
    df = spark.createDataFrame([("f/a.xlsx", bytearray(made.getvalue()), 7), ("f/b.csv", None, 8), (None, bytearray(b"x"), 9)], "path string, content binary, row int")
    out = B.unpack(df.withColumnRenamed("row", "extra")).collect()
    good = [r.payload for r in out if r.extra == 7]
    assert good == [{"a": "1904-01-02 12:00:00", "bb": None, "c": None}, {"a": None, "bb": "3", "c": "4"}, {"a": "06:00:00", "bb": None, "c": None}]
    assert {r.extra for r in out if r.error} == {8, 9} and B.unpack(df.withColumnRenamed("row", "extra").where("false")).count() == 0


def test_names_follow_the_column_rule(spark):
    headers = ["  Pass, % ", "A__b", "Straße-ß", "É 1", "!!"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in headers], "h string").select(plain_name(F.col("h"))).collect()]
    assert [x or f"unnamed_{i}" for i, x in enumerate(got)] == B.column_names(headers)


def test_merge_and_summary(spark):
    rows = [("a", 1, 5, {"m": "10", "n": "1", "x": None}, None), ("a", 2, 5, {"m": "3", "n": "1", "x": "1"}, None), ("b", 1, 5, {"m": "3", "n": "2", "x": "1"}, None), ("b", 2, None, {"m": "1"}, None), ("b", 3, 6, {"m": "1"}, None), ("c", None, None, None, "bad")]
    df = spark.createDataFrame(rows, "path string, row int, player_id int, payload map<string,string>, error string")
    merged = {r.player_id: (r.path, r.row) for r in B.merge_rows(df, ["player_id"], "m", "n").collect()}
    assert merged == {5: ("b", 1), 6: ("b", 3)}
    got = {r.path: tuple(r)[1:] for r in B.file_summary(df, ["player_id"]).collect()}
    assert got == {"a": (2, 1, 1, 0, None), "b": (3, 2, 0, 1, None), "c": (0, 0, 0, 0, "bad")}


@pytest.mark.parametrize("extra", [False, True])
def test_periods_of_files(spark, extra):
    files = [(1, "r/x 23-24.csv"), (1, "r/one.csv"), (1, "r/none.csv"), *([(1, "r/two.csv")] if extra else []), (2, "r/other.csv")]
    teams = [(1, "r/one.csv", t) for t in "abc"] + [(1, "r/two.csv", t) for t in "ab"] + [(1, "r/none.csv", "q"), (2, "r/other.csv", "a"), (1, "r/x 23-24.csv", "z")]
    known = [(1, "2023", t) for t in "abc"] + [(1, "2022", t) for t in "ab"] + [(1, "2021", "c"), (2, "2020", "a"), (2, "2019", "a")]
    made, left = B.assign_periods(spark.createDataFrame(files, "cohort_id int, path string"), spark.createDataFrame(teams, "cohort_id int, path string, team string"), spark.createDataFrame(known, "cohort_id int, period string, team string"))
    got = {r.path: r.period for r in made.collect()}
    gone = {r.path: r.reason for r in left.collect()}
    assert got == {"r/x 23-24.csv": "2023", "r/other.csv": "2019"} | ({} if extra else {"r/one.csv": "2022"})
    clash = "another file claims the period"
    assert gone == {"r/none.csv": "no period overlaps"} | ({"r/one.csv": clash, "r/two.csv": clash} if extra else {})
