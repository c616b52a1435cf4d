"""Star-schema tables in the library's vocabulary: units of entities with cohort, segment, period and exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, EVENTS_AS_OF = "2001-08-02", "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines; sums are of cents and ten-thousandths, so rounding makes them exact."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_quantity"), 2).alias("exposure"), F.round(F.sum("l_extendedprice"), 2).alias("m1"),
        F.count("*").cast("double").alias("m2"), (F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4) + 0.0).alias("m3"),
    )
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("unit"), F.col("c_nationkey").alias("cohort"), F.col("c_mktsegment").alias("segment"),
        F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderdate").alias("ts"), "exposure", "m1", "m2", "m3",
        F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status"),
    )


UNITS_SQL = """l AS (
  SELECT l_orderkey, round(sum(l_quantity), 2) exposure, round(sum(l_extendedprice), 2) m1, CAST(count(*) AS DOUBLE) m2,
         round(sum(l_extendedprice * l_discount), 4) + 0.0 m3 FROM lineitem GROUP BY 1
), u AS (
  SELECT o_custkey entity, o_orderkey unit, c_nationkey cohort, c_mktsegment segment, CAST(year(o_orderdate) AS VARCHAR) period,
         o_orderdate ts, exposure, m1, m2, m3, o_orderpriority label, o_orderstatus status
  FROM orders JOIN l ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, by supplier."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("entity"), F.col("o_orderkey").alias("unit"), F.col("l_linenumber").alias("line"), F.col("s_nationkey").alias("cohort"),
        F.col("l_returnflag").alias("segment"), F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderdate").alias("ts"),
        F.col("l_quantity").alias("exposure"), F.col("l_extendedprice").alias("m1"), F.col("o_orderpriority").alias("label"),
    )


SUPPLY_SQL = """s AS (
  SELECT l_suppkey entity, o_orderkey unit, l_linenumber line, s_nationkey cohort, l_returnflag segment, CAST(year(o_orderdate) AS VARCHAR) period,
         o_orderdate ts, l_quantity exposure, l_extendedprice m1, o_orderpriority label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region, nation and month the nation's rank in its region by revenue."""
    from pyspark.sql import Window as W

    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cohort"), F.col("n_regionkey").alias("region"))
    month = units(spark, sf_dir).join(nations, "cohort").groupBy("region", "cohort", F.to_date(F.date_trunc("month", "ts")).alias("day")).agg(F.round(F.sum("m1"), 2).alias("revenue"))
    return month.withColumn("position", F.row_number().over(W.partitionBy("region", "day").orderBy(F.desc("revenue"), "cohort")))


SNAPSHOTS_SQL = UNITS_SQL + """, n AS (
  SELECT *, row_number() OVER (PARTITION BY region, day ORDER BY revenue DESC, cohort) AS position FROM (
    SELECT n_regionkey region, cohort, CAST(date_trunc('month', ts) AS DATE) AS day, round(sum(m1), 2) revenue
    FROM u JOIN nation ON n_nationkey = cohort GROUP BY ALL)
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("unit"), "ts", "event_type", "value", "props")


EVENTS_SQL = "e AS (SELECT user_id entity, event_id unit, ts, event_type, value, props FROM events)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("entity"), F.col("source").alias("brief"), "lang", F.col("n_chars").alias("score"), F.col("quality").alias("hit"), (1 - F.col("toxic")).alias("hit2"))


OUTCOMES_SQL = "o AS (SELECT doc_id entity, source brief, lang, n_chars score, quality hit, 1 - toxic hit2 FROM documents JOIN labels USING (doc_id))"
