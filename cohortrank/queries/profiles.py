"""Use of entities in lineups against the limits of a role, and pathways, on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortrank.plans import profiles as R
from cohortrank.queries.adapters import table
from cohortrank.queries.relational import r4
from cohortrank.registry import query

LINEUPS_SQL = """p AS (SELECT l_suppkey AS entity, l_orderkey AS unit, l_linestatus AS team, l_linenumber <= 5 AS is_starter, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'F' WHEN l_returnflag = 'N' THEN 'M' ELSE 'D' END AS label,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 1 + l_orderkey % 5 END AS line, 1 + CAST(l_quantity AS INT) % 4 AS place FROM lineitem),
z AS (SELECT *, coalesce(label IN ('F', 'M') AND line >= 3, false) AS zone FROM p WHERE is_starter),
w AS (SELECT *, max(CASE WHEN zone THEN place END) OVER (PARTITION BY entity, unit, team, line) AS width FROM z),
c AS (SELECT *, width = 1 OR (width = 2 AND label = 'F') OR (width >= 3 AND place > 1 AND place < width) AS central, width >= 3 AND (place = 1 OR place = width) AS wide FROM w),
us AS (SELECT entity, count(label) AS label_rows, avg(CAST(label = 'F' AS INT)) AS forward_share, avg(CAST(label = 'M' AS INT)) AS midfield_share, count(*) FILTER (zone AND (central OR wide)) AS zone_rows,
  avg(CAST(central AS INT)) FILTER (zone AND (central OR wide)) AS central_share, avg(CAST(wide AS INT)) FILTER (zone AND (central OR wide)) AS wide_share FROM c GROUP BY 1)"""


def starts(spark, d):
    """Order lines as lineups: suppliers are entities, five lines of an order start."""
    li, part = table(spark, d, "lineitem"), F.col("l_partkey")
    label = F.when(part % 7 == 0, None).when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "M").otherwise("D")
    grid = F.when(part % 11 != 0, F.concat_ws(":", (1 + F.col("l_orderkey") % 5).cast("string"), (1 + F.col("l_quantity").cast("int") % 4).cast("string")))
    lineups = li.select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("unit"), F.col("l_linestatus").alias("team"), (F.col("l_linenumber") <= 5).alias("is_starter"), label.alias("label"), grid.alias("grid"))
    return R.usage(lineups, ["entity"])


@query(f"WITH {LINEUPS_SQL} SELECT entity, label_rows, zone_rows, rup(forward_share, 4) AS forward_share, rup(midfield_share, 4) AS midfield_share, rup(central_share, 4) AS central_share, rup(wide_share, 4) AS wide_share FROM us")
def attack_usage(spark, d):
    shares = ("forward_share", "midfield_share", "central_share", "wide_share")
    return starts(spark, d).select("entity", "label_rows", "zone_rows", *(r4(F.col(c), c) for c in shares))


ROLE = R.Role(175.0, (R.Limit("forward_share", "label_rows", "share of starts as F", least=0.24, enough=20), R.Limit("midfield_share", "label_rows", "share of starts as M", most=0.52, enough=20), R.Limit("central_share", "zone_rows", "share of central use", least=0.35, enough=40)))


@query(f"""WITH {LINEUPS_SQL}, g AS (SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 170 + s_suppkey % 30 END AS height, coalesce(label_rows, 0) AS lr, coalesce(zone_rows, 0) AS zr, us.* EXCLUDE (entity) FROM supplier LEFT JOIN us ON us.entity = s_suppkey),
m AS (SELECT entity, CAST(coalesce(height < 175, false) AS INT) + CAST(lr >= 20 AND forward_share < 0.24 AS INT) + CAST(lr >= 20 AND midfield_share > 0.52 AS INT) + CAST(zr >= 40 AND coalesce(central_share < 0.35, false) AS INT) AS f, CAST(height IS NULL AS INT) + CAST(lr < 20 AS INT) + CAST(zr < 40 AS INT) AS k FROM g)
SELECT entity, CASE WHEN f > 0 THEN 'fail' WHEN k > 0 THEN 'caution' ELSE 'pass' END AS result, CASE WHEN f > 0 THEN f ELSE k END AS messages FROM m""")
def role_profile_gate(spark, d):
    """Suppliers as candidates; every sixth has no height."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("entity"), F.when(k % 6 != 0, 170 + k % 30).alias("height")).join(starts(spark, d), "entity", "left").select("entity", R.role_gate(ROLE).alias("g"))
    return rows.select("entity", "g.result", F.when(F.col("g.detail") == "", 0).otherwise(F.size(F.split("g.detail", " ; "))).alias("messages"))


@query("""WITH o AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 3 % 30 END AS months, 20 + n_nationkey % 10 AS age FROM nation WHERE n_nationkey % 7 <> 6),
c AS (SELECT c_custkey AS entity, c_nationkey, CASE WHEN c_custkey % 8 <> 0 THEN 18 + c_custkey % 15 END AS age, 1 + c_custkey % 4 AS years FROM customer)
SELECT entity, CASE WHEN months < 12 AND c.age <= o.age AND years > 2 THEN 'fail' ELSE 'pass' END AS pathway, CASE WHEN months BETWEEN 12 AND 24 AND years > 2 THEN 'exception' ELSE 'pass' END AS pathway_soft FROM c LEFT JOIN o ON n_nationkey = c_nationkey""")
def pathway_gates(spark, d):
    """Customers as candidates of their nation; a nation has one internal option, some have none or one of no estimate."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    people = table(spark, d, "customer").select(k.alias("entity"), F.col("c_nationkey").alias("segment"), F.when(k % 8 != 0, 18 + k % 15).alias("age"), (1 + k % 4).alias("contract_years"))
    options = table(spark, d, "nation").where(n % 7 != 6).select(n.alias("segment"), F.when(n % 5 != 0, n * 3 % 30).alias("option_months"), (20 + n % 10).alias("option_age"))
    return R.pathways(people, options).select("entity", "pathway", "pathway_soft")
