"""Workbook folders: files are packed from the given tables and read back by the library."""

from __future__ import annotations

import csv
import io
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrank.functions import scalars as S
from cohortrank.queries.adapters import table
from cohortrank.registry import query
from cohortrank.sources import workbooks as B

HEADER = ["Id", "Name", "Minutes played", "Balance, %", "Segment", "Since"]


@F.pandas_udf(T.BinaryType())
def packed(rows: pd.Series, copy: pd.Series) -> pd.Series:
    """Arrays of lines as workbooks, or as CSV files where copy is 1."""

    def one(held, plain_text):
        lines = [[None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row.values()] for row in held]
        if not plain_text:
            return B.pack(HEADER, lines)
        out = io.StringIO()
        csv.writer(out).writerows([HEADER, *([f"{x:%Y-%m-%d}" if isinstance(x, datetime) else x for x in line] for line in lines)])
        return out.getvalue().encode()

    return pd.Series([one(*x) for x in zip(rows, copy, strict=True)])


def landed(spark, d):
    """Customers in a folder for each nation: a workbook for each thousand, and a CSV file of every third customer
    with ten minutes more, of every sixth without balance. Nations of a number that ends in 4 or 9 have no alias."""
    k = F.col("c_custkey")
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("copy", F.explode(F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    line = F.struct(
        F.when((F.col("copy") == 0) | (k % 9 != 0), k).alias("id"), F.col("c_name").alias("name"), (k % 900 + 10 * F.col("copy")).alias("minutes"),
        F.when((F.col("copy") == 0) | (k % 6 != 0), F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("segment"), F.date_add(F.lit("2001-01-01").cast("date"), (k % 5000).cast("int")).cast("timestamp").alias("since"),
    )
    part = F.floor(k / 1000).cast("string")
    files = both.groupBy("n_name", "copy", part.alias("part")).agg(F.sort_array(F.collect_list(line)).alias("held"))  # at most a thousand lines each
    name = F.concat(F.lit("/exports/"), "n_name", F.lit("/part "), "part", F.when(F.col("copy") == 0, ".xlsx").otherwise(".csv"))
    aliases = {r.n_name: r.n_nationkey for r in table(spark, d, "nation").where("n_nationkey % 5 <> 4").collect()}
    rows = B.unpack(B.under_cohorts(files.select(name.alias("path"), packed("held", "copy").alias("content")), aliases))
    return rows.withColumn("player_id", S.tolerant_int(F.try_element_at("payload", F.lit("id"))).cast("long"))


@query("""SELECT c_custkey AS player_id, c_nationkey AS cohort_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 AND c_custkey % 9 <> 0 THEN c_custkey % 900 + 10 ELSE c_custkey % 900 END AS minutes,
  c_acctbal AS balance, DATE '2001-01-01' + CAST(c_custkey % 5000 AS INT) AS since, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 AND c_custkey % 9 <> 0 THEN 'csv' ELSE 'xlsx' END AS kind
FROM customer WHERE c_nationkey % 5 <> 4""")
def workbook_rows(spark, d):
    """Of a customer's rows over all files the fullest, then the one of most minutes."""
    best = B.merge_rows(landed(spark, d), ["player_id", "cohort_id"], "minutes_played", "matches_played")
    get = lambda name: F.try_element_at("payload", F.lit(name))
    return best.select("player_id", "cohort_id", get("name").alias("name"), S.tolerant_int(get("minutes_played")).cast("long").alias("minutes"), get("balance").cast("double").alias("balance"), get("since").cast("date").alias("since"), F.regexp_extract("path", r"(\w+)$", 1).alias("kind"))


@query("""SELECT '/exports/' || n_name || '/part ' || CAST(c_custkey // 1000 AS VARCHAR) || '.xlsx' AS path, count(*) AS source_rows, count(*) AS resolved_rows, 0 AS duplicate_rows_merged, 0 AS unmatched_rows FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 5 <> 4 GROUP BY 1
UNION ALL SELECT '/exports/' || n_name || '/part ' || CAST(c_custkey // 1000 AS VARCHAR) || '.csv', count(*), count(*) FILTER (c_custkey % 9 <> 0), 0, count(*) FILTER (c_custkey % 9 = 0) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 5 <> 4 AND c_custkey % 3 = 0 GROUP BY 1""")
def workbook_summary(spark, d):
    """What each file held and how many of its rows have a key."""
    return B.file_summary(landed(spark, d), ["player_id"]).drop("error")


FILES_SQL = """f AS (SELECT DISTINCT o_custkey % 25 AS cohort_id, o_custkey, l_suppkey AS team, CASE WHEN o_custkey % 50 < 3 THEN '20' || substr(CAST(year(o_orderdate) AS VARCHAR), 3) END AS own FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
n AS (SELECT cohort_id, o_custkey, min(own) AS own FROM f GROUP BY 1, 2), k AS (SELECT DISTINCT o_custkey % 25 AS cohort_id, '20' || substr(CAST(year(o_orderdate) AS VARCHAR), 3) AS period, l_suppkey AS team FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
o AS (SELECT f.cohort_id, f.o_custkey, k.period, count(DISTINCT f.team) AS n FROM f JOIN n USING (cohort_id, o_custkey) JOIN k ON k.cohort_id = f.cohort_id AND k.team = f.team
  WHERE n.own IS NULL AND (k.cohort_id, k.period) NOT IN (SELECT cohort_id, own FROM n WHERE own IS NOT NULL) GROUP BY 1, 2, 3),
b AS (SELECT *, count(*) OVER (PARTITION BY cohort_id, period) AS claims FROM (SELECT *, row_number() OVER (PARTITION BY cohort_id, o_custkey ORDER BY n DESC, period) AS r FROM o) WHERE r = 1)"""


@query(f"""WITH {FILES_SQL} SELECT cohort_id, o_custkey AS file, coalesce(n.own, b.period) AS period, CASE WHEN n.own IS NOT NULL THEN NULL WHEN b.period IS NULL THEN 'no period overlaps' WHEN claims > 1 THEN 'another file claims the period' END AS reason
FROM n LEFT JOIN b USING (cohort_id, o_custkey)""")
def file_periods(spark, d):
    """Customers as files of a cohort, suppliers as the teams in them; two or three of each fifty name their period."""
    year = F.concat(F.lit("20"), F.date_format("o_orderdate", "yy"))  # as names tell it
    sold = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sold = sold.withColumns({"cohort_id": F.col("o_custkey") % 25, "period": year, "team": F.col("l_suppkey")})
    first = F.when(F.col("o_custkey") % 50 < 3, F.substring(F.min("period"), 3, 2).cast("int"))
    span = F.coalesce(F.concat(F.lit(" "), F.lpad(first.cast("string"), 2, "0"), F.lit(" - "), F.lpad((first + 1).cast("string"), 2, "0")), F.lit(""))
    named = sold.groupBy("cohort_id", "o_custkey").agg(span.alias("span")).withColumn("path", F.concat(F.lit("/exports/"), F.col("o_custkey").cast("string"), F.lit("/table"), "span", F.lit(".csv")))
    teams = sold.select("cohort_id", "o_custkey", "team").distinct().join(named.select("o_custkey", "path"), "o_custkey")
    known = sold.where("l_returnflag = 'R'").select("cohort_id", "period", "team").distinct()
    made, left = B.assign_periods(named.select("cohort_id", "path"), teams, known)
    out = made.withColumn("reason", F.lit(None).cast("string")).unionByName(left)
    return out.select("cohort_id", F.regexp_extract("path", r"/(\d+)/", 1).cast("long").alias("file"), "period", "reason")
