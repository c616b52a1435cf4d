"""Folders of exports: workbooks and CSV files, each with columns of its own, as rows of plain names to texts."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrank.functions import scalars as S
from cohortrank.sources.payloads import plain_name

#: Cells that stand for no value.
MISSING = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}
#: Number formats of days and times that a workbook need not spell out.
DAY_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
SUFFIXES = ["csv", "xlsx", "xlsm"]
ROWS = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("payload", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, csv.Error, KeyError, IndexError, ValueError, EOFError, NotImplementedError)


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def children(element: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in element if local(x) == name]


def plain(element: ElementTree.Element) -> str:
    """Text of a string item, of one run or many; readings beside it are left out."""
    runs = [element, *children(element, "r")]
    return "".join(t.text or "" for run in runs for t in children(run, "t"))


def day_styles(styles: ElementTree.Element) -> set[int]:
    """Numbers of the cell styles that show a number as a day or a time."""
    shown = set(DAY_FORMATS)
    for x in styles.iter():
        if local(x) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", x.get("formatCode", ""), flags=re.I)
            if re.search("[ymdhs]", code, re.I):
                shown.add(int(x.get("numFmtId")))
    cells = [x for part in styles if local(part) == "cellXfs" for x in part]
    return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in shown}


def day_text(serial: float, since_1904: bool) -> str:
    """A serial day as ISO text, without a time at midnight, without a day below 1. The calendar of 1900 has a
    29 February, so days before it lie one further."""
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if 1 <= serial < 60 else 30)
    at = start + timedelta(seconds=round(serial * 86400))
    return at.strftime("%H:%M:%S") if 0 < serial < 1 else at.strftime("%Y-%m-%d" if at == at.replace(hour=0, minute=0, second=0) else "%Y-%m-%d %H:%M:%S")


def workbook_rows(data: bytes) -> Iterator[list[str | None]]:
    """Rows of a workbook's first sheet as texts; a number stays as it is written, a day is ISO text."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        names = set(parts.namelist())
        tree = lambda name: ElementTree.fromstring(parts.read(name))
        book = tree("xl/workbook.xml")
        ident = next(v for x in book.iter() if local(x) == "sheet" for k, v in x.attrib.items() if k.endswith("}id"))
        target = next(x.get("Target") for x in tree("xl/_rels/workbook.xml.rels") if x.get("Id") == ident)
        since_1904 = any(x.get("date1904") in ("1", "true") for x in book.iter() if local(x) == "workbookPr")
        texts = [plain(x) for x in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        days = day_styles(tree("xl/styles.xml")) if "xl/styles.xml" in names else set()

        def text(cell: ElementTree.Element) -> str | None:
            kind, held = cell.get("t", "n"), next((x.text for x in children(cell, "v")), None)
            if kind == "inlineStr":
                return "".join(map(plain, children(cell, "is")))
            if held is None or kind == "e":
                return None
            if kind == "s":
                return texts[int(held)]
            if kind == "b":
                return "true" if held == "1" else "false"
            return day_text(float(held), since_1904) if kind == "n" and int(cell.get("s", 0)) in days else held

        with parts.open(posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if local(element) == "row":
                    row: list[str | None] = []
                    for cell in children(element, "c"):
                        at = 0
                        for c in re.match("[A-Z]*", cell.get("r", "").upper()).group():
                            at = at * 26 + ord(c) - 64
                        row += [None] * (at - 1 - len(row))
                        row.append(text(cell))
                    yield row
                    element.clear()


def csv_rows(data: bytes) -> Iterator[list[str | None]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), strict=True)


def column_names(header: list[str | None]) -> list[str]:
    """plain_name() of each header; one that is blank goes by its place, one that repeats by its count."""
    out: list[str] = []
    for i, text in enumerate(header):
        name = re.sub(r"[\W_]+", "_", (text or "").strip().lower()).strip("_") or f"unnamed_{i}"
        free, k = name, 0
        while free in out:
            k += 1
            free = f"{name}_{k}"
        out.append(free)
    return out


def records(path: str, data: bytes) -> list[list[tuple[str, str | None]]]:
    """A file's rows under its first row with a value; rows without one go, cells beyond the header too."""
    rows = csv_rows(data) if path.lower().endswith(".csv") else workbook_rows(data)
    held = ([None if x is None or x.strip() in MISSING else x for x in row] for row in rows)
    full = (row for row in held if any(x is not None for x in row))
    names = column_names(next(full, []))
    return [list(zip(names, row + [None] * (len(names) - len(row)))) for row in full if any(x is not None for x in row[: len(names)])]


def unpack(files: DataFrame) -> DataFrame:
    """Rows of files (path, content, any others): the other columns, path, row (from 1) and payload, a map of plain names to
    texts. A file that cannot be read, or has no content, gives one row with an error and no payload; none of its rows
    come along. A file is taken by one task, as its sheet is one compressed stream; its rows leave 4096 at a time."""
    rest = [f for f in files.schema.fields if f.name not in ("content", *ROWS.names)]
    schema = T.StructType([*rest, *ROWS.fields])
    kinds = [pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                try:
                    if data is None:
                        raise ValueError("no content")
                    rows, error = records(path or "", data), None
                except BROKEN as e:
                    rows, error = [None], f"{type(e).__name__}: {e}"
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    own = [[None if error else k + j + 1 for j in range(len(part))], part, [error] * len(part)]
                    same = pa.array([i] * len(part), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(same) for f in rest), *map(pa.array, own, kinds)], schema.names)

    return files.select(*(f.name for f in rest), "content").mapInArrow(run, schema)


def under_cohorts(files: DataFrame, aliases: dict[str, int], folders: list[str] | None = None) -> DataFrame:
    """Files with the folder that holds them and its cohort_id, by the folder's plain name; those of folders that
    have no alias, or are not among folders, go before they are unpacked."""
    table = files.sparkSession.createDataFrame(list(aliases.items()), "alias string, cohort_id int")
    table = table.select(plain_name(F.col("alias")).alias("_folder"), "cohort_id").dropDuplicates(["_folder"])
    if folders is not None:
        wanted = files.sparkSession.createDataFrame([(x,) for x in folders], "alias string").select(plain_name(F.col("alias")).alias("_folder"))
        table = table.join(wanted, "_folder", "left_semi")
    held = files.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("_folder", plain_name(F.col("folder")))
    return held.join(F.broadcast(table), "_folder").drop("_folder")  # the aliases are an argument, so they are few


def read_root(spark: SparkSession, root: str, aliases: dict[str, int], folders: list[str] | None = None) -> DataFrame:
    """All rows of the cohort folders below root, at any depth: path, folder, cohort_id, row, payload, error."""
    kinds = ",".join(f"*.{x},*.{x.upper()}" for x in SUFFIXES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{kinds}}}").load(root)
    return unpack(under_cohorts(files.select("path", "content"), aliases, folders))


def merge_rows(rows: DataFrame, keys: list[str], exposure: str, count: str) -> DataFrame:
    """Of rows with one key the one with most values, then of more exposure, then of more units (both names of the
    payload), then the first by path and row. Rows with a null key and errors go."""
    number = lambda name: F.coalesce(S.tolerant_double(F.try_element_at("payload", F.lit(name))), F.lit(0.0))
    filled = F.size(F.filter(F.map_values("payload"), lambda x: x.isNotNull()))
    rank = F.struct(filled, number(exposure), number(count))
    whole = F.struct(*(F.col(c) for c in rows.columns if c not in keys))
    good = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys) + " AND payload IS NOT NULL")
    held = good.select(*keys, rank.alias("_rank"), whole.alias("_row"))
    order = W.partitionBy(*keys).orderBy(F.desc("_rank"), "_row.path", "_row.row")
    return held.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*keys, "_row.*")


def file_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: source_rows, resolved_rows (distinct keys), duplicate_rows_merged, unmatched_rows (a null key) and the error of
    a file that could not be read. rows are those of unpack() with the keys resolved."""
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    per_key = rows.groupBy("path", *keys).agg(F.count("payload").alias("n"), F.first("error", ignorenulls=True).alias("error"))
    found = F.when(keyed & (F.col("n") > 0), 1).otherwise(0)
    out = per_key.groupBy("path").agg(F.sum("n").alias("source_rows"), F.sum(found).alias("resolved_rows"), F.sum(F.when(keyed, F.col("n")).otherwise(0)).alias("_keyed"), F.first("error", ignorenulls=True).alias("error"))
    return out.select("path", "source_rows", "resolved_rows", (F.col("_keyed") - F.col("resolved_rows")).alias("duplicate_rows_merged"), (F.col("source_rows") - F.col("_keyed")).alias("unmatched_rows"), "error")


def assign_periods(files: DataFrame, teams: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Periods of files (cohort_id, path), and the rejects with a reason. A name that tells its period decides. Any other
    file takes, of the cohort's periods that no name claims, the one with which its teams (cohort_id, path, team) overlap most in
    known (cohort_id, period, team), ties to the earlier; files that claim the same period so are rejected, and those
    that overlap with none."""
    named = files.select("cohort_id", "path", S.period_from_name(F.regexp_extract("path", "([^/]+)$", 1)).alias("period"))
    by_name, vague = named.where("period IS NOT NULL"), named.where("period IS NULL").drop("period")
    free = known.join(by_name, ["cohort_id", "period"], "left_anti").select("cohort_id", "period", "team").distinct()
    held = teams.join(vague, ["cohort_id", "path"], "left_semi").select("cohort_id", "path", "team").distinct()
    overlap = held.join(free, ["cohort_id", "team"]).groupBy("cohort_id", "path", "period").agg(F.count("*").alias("n"))
    best = overlap.groupBy("cohort_id", "path").agg(F.min_by("period", F.struct(-F.col("n"), "period")).alias("period"))
    claims = best.groupBy("cohort_id", "period").agg(F.count("*").alias("claims"))
    out = vague.join(best, ["cohort_id", "path"], "left").join(claims, ["cohort_id", "period"], "left")
    reason = F.when(F.col("period").isNull(), "no period overlaps").when(F.col("claims") > 1, "another file claims the period")
    out = out.select("cohort_id", "path", "period", reason.alias("reason"))
    return by_name.unionByName(out.where("reason IS NULL").drop("reason")), out.where("reason IS NOT NULL")


def pack(header: list[str], rows: list[list]) -> bytes:
    """A workbook of one sheet: texts shared, numbers as written, days by style, None left out."""
    texts: dict[str, int] = {}

    def cell(x, at: str) -> str:
        if x is None:
            return ""
        if isinstance(x, bool):
            return f'<c r="{at}" t="b"><v>{int(x)}</v></c>'
        if isinstance(x, datetime):
            return f'<c r="{at}" s="1"><v>{(x - datetime(1899, 12, 30)).total_seconds() / 86400!r}</v></c>'
        if isinstance(x, (int, float)):
            return f'<c r="{at}"><v>{x!r}</v></c>'
        return f'<c r="{at}" t="s"><v>{texts.setdefault(str(x), len(texts))}</v></c>'

    def letters(k: int) -> str:
        return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    body = "".join(f'<row r="{i}">' + "".join(cell(x, f"{letters(k)}{i}") for k, x in enumerate(row)) + "</row>" for i, row in enumerate([header, *rows], 1))
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    made = {"xl/workbook.xml": "sheet.main", "xl/worksheets/sheet1.xml": "worksheet", "xl/sharedStrings.xml": "sharedStrings", "xl/styles.xml": "styles"}
    linked = "".join(f'<Relationship Id="r{i}" Type="{office}/{t}" Target="{p}"/>' for i, (t, p) in enumerate([("worksheet", "worksheets/sheet1.xml"), ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")]))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        + "".join(f'<Override PartName="/{p}" ContentType="{kind}.{t}+xml"/>' for p, t in made.items()) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r0" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{linked}</Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="rows" sheetId="1" r:id="r0"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">' + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in texts) + "</sst>",
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
