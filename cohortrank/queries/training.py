"""Point-in-time training rows on the star schema: an order's priority is its cohort, the customer's segment its team."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.plans import training as P
from cohortrank.queries.adapters import UNITS_SQL, table, units
from cohortrank.queries.relational import r4
from cohortrank.registry import query, round_up
from cohortrank.storage import written_once

BASE = f"WITH {UNITS_SQL}" + """, m AS (SELECT entity, unit, period, label AS cohort, segment AS team, exposure, m1, m3, status <> 'F' AS substitute, CAST(ts AS DATE) AS made FROM u),
ro AS (SELECT entity, make_date(CAST(period AS INT) + 1, 1, 1) AS day, min(status) AS role FROM u GROUP BY 1, 2), bo AS (SELECT entity, CAST(min(ts) AS DATE) - 8000 AS born FROM u GROUP BY 1) """
WEIGHTS = {"m1": 0.0003, "m2": 0.2, "m3": 0.005}


def inputs(spark, d):
    """units, roles known from the end of their period, and days of birth."""
    u = written_once(units(spark, d), "units")
    roles = u.groupBy("entity", F.make_date(F.col("period").cast("int") + 1, F.lit(1), F.lit(1)).alias("day")).agg(F.min("status").alias("role"))
    return u, roles, u.groupBy("entity").agg(F.date_sub(F.to_date(F.min("ts")), 8000).alias("born"))


def places(u):
    """Each month's place of a team in its cohort by revenue, known at the month's end."""
    month = F.last_day(F.to_date("ts"))
    g = u.groupBy(F.col("label").alias("cohort"), F.col("segment").alias("team"), month.alias("day")).agg(F.round(F.sum("m1"), 2).alias("revenue"))
    return g.withColumn("position", F.row_number().over(W.partitionBy("cohort", "day").orderBy(F.desc("revenue"), "team")))


@query(BASE + """, pl AS (SELECT *, row_number() OVER (PARTITION BY cohort, day ORDER BY revenue DESC, team) AS position FROM (SELECT cohort, team, last_day(made) AS day, round(sum(m1), 2) AS revenue FROM m GROUP BY ALL)),
g AS (SELECT entity, period, cohort, sum(exposure) AS x, count(*) AS n, count(*) FILTER (NOT substitute) AS st, max(team) AS team, sum(m1) AS m1, sum(m3) AS m3 FROM m GROUP BY 1, 2, 3 HAVING sum(exposure) >= 60),
mv AS (SELECT *, lead(period) OVER w AS np, lead(cohort) OVER w AS nc, lead(team) OVER w AS nt, lead(x) OVER w AS nx, lead(st) OVER w / lead(n) OVER w AS ss, lead(m1) OVER w AS n1, lead(m3) OVER w AS n3 FROM g WINDOW w AS (PARTITION BY entity ORDER BY period, cohort)),
k AS (SELECT *, make_date(CAST(np AS INT), 1, 1) AS ref FROM mv WHERE nc <> cohort AND nx >= 80)
SELECT k.entity, k.period, np AS next_period, k.cohort, nc AS next_cohort, round(date_diff('day', born, ref) / 365.25, 1) AS age, coalesce(role, 'unknown') AS role, coalesce(a.position, 12)::DOUBLE AS origin_position, coalesce(b.position, 12)::DOUBLE AS target_position,
 rup(k.m1 / greatest(x, 1) * 90, 3) AS origin_m1, rup(k.m3 / greatest(x, 1) * 90, 3) AS origin_m3, rup(n1 / greatest(nx, 1) * 90, 3) AS target_m1, rup(n3 / greatest(nx, 1) * 90, 3) AS target_m3, CAST(ss >= 0.75 AS INT) AS target_starter
FROM k ASOF LEFT JOIN pl a ON a.cohort = k.cohort AND a.team = k.team AND ref >= a.day ASOF LEFT JOIN pl b ON b.cohort = k.nc AND b.team = k.nt AND ref >= b.day ASOF LEFT JOIN ro ON ro.entity = k.entity AND ref >= ro.day LEFT JOIN bo ON bo.entity = k.entity""")
def projection_rows(spark, d):
    u, roles, born = inputs(spark, d)
    matches = u.select("entity", "period", F.col("label").alias("cohort"), F.col("segment").alias("team"), "exposure", "m1", "m3", (F.col("status") != "F").alias("substitute"))
    out = P.projection_rows(matches, places(u), roles, born, ["m1", "m3"], before=60, after=80)
    rates = [f"{side}_{m}" for side in ("origin", "target") for m in ("m1", "m3")]
    return out.select("entity", "period", "next_period", "cohort", "next_cohort", "age", "role", "origin_position", "target_position", *(round_up(c, 3).alias(c) for c in rates), "target_starter")


@query(BASE + f""", va AS (SELECT o_custkey AS entity, CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS value, CAST(l_shipdate AS DATE) + 400 AS contract_end FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
se AS (SELECT entity, make_date(CAST(period AS INT), 12, 31) AS day, min(cohort) AS cohort, max(label) AS label, sum(exposure) AS x, sum(m1) AS m1, sum(m2) AS m2, sum(m3) AS m3 FROM u GROUP BY 1, 2),
si AS (SELECT unit AS signing, entity, CAST(ts AS DATE) AS day, m1 AS fee FROM u WHERE status = 'F' AND m1 > 0)
SELECT si.signing, si.entity, round(date_diff('day', born, si.day) / 365.25, 1) AS age, coalesce(upper(substr(label, 1, 1)), 'U') AS position_group, coalesce(role, 'unknown') AS role, coalesce(CASE WHEN cohort % 4 < 3 THEN cohort % 4 + 1 END, 3)::DOUBLE AS level,
 rup(coalesce(greatest(0, date_diff('day', si.day, contract_end) / 365.25), 0), 4) AS contract_years, coalesce(value, 0) AS value,
 rup(coalesce(m1 / greatest(x, 1) * 90 * {WEIGHTS['m1']} + m2 / greatest(x, 1) * 90 * {WEIGHTS['m2']} + m3 / greatest(x, 1) * 90 * {WEIGHTS['m3']}, 0), 4) AS output, fee
FROM si ASOF LEFT JOIN va ON va.entity = si.entity AND si.day >= va.day ASOF LEFT JOIN se ON se.entity = si.entity AND si.day >= se.day ASOF LEFT JOIN ro ON ro.entity = si.entity AND si.day >= ro.day LEFT JOIN bo ON bo.entity = si.entity""")
def fee_rows(spark, d):
    u, roles, born = inputs(spark, d)
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    values = lines.groupBy(F.col("o_custkey").alias("entity"), F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value")).withColumn("contract_end", F.date_add("day", 400))
    seasons = u.groupBy("entity", F.make_date(F.col("period").cast("int"), F.lit(12), F.lit(31)).alias("day")).agg(F.min("cohort").alias("cohort"), F.max("label").alias("label"), *(F.sum(c).alias(c) for c in ("exposure", "m1", "m2", "m3")))
    cohorts = table(spark, d, "nation").select(F.col("n_nationkey").alias("cohort"), F.when(F.col("n_nationkey") % 4 < 3, F.col("n_nationkey") % 4 + 1).alias("level"))
    signings = u.where("status = 'F'").select(F.col("unit").alias("signing"), "entity", F.to_date("ts").alias("day"), F.col("m1").alias("fee"))
    out = P.fee_rows(signings, values, seasons, roles, cohorts, born, WEIGHTS)
    return out.select("signing", "entity", "age", "position_group", "role", "level", r4(F.col("contract_years"), "contract_years"), "value", r4(F.col("output"), "output"), "fee")


@query()
def target_projections(spark, d):
    """Both targets and the starter's chance of every training row, with the intervals of rows that a model has not seen."""
    from cohortrank.models import projections as M

    moves = written_once(projection_rows(spark, d), "moves")
    fitted = M.fit_targets(moves, ["entity", "period"], ["age", "origin_position", "target_position", "origin_m1", "origin_m3"], ["cohort", "next_cohort", "role"], ["target_m1", "target_m3"], "target_starter", ["cohort", "next_cohort"])
    out = M.project_targets(moves, fitted)
    bands = [F.round(f"{t}_{p}", 3).alias(f"{t}_{p}") for t in ("target_m1", "target_m3") for p in ("p10", "p50", "p90")]
    return out.select("entity", "period", "cohort", "next_cohort", *bands, F.round("starter_chance", 4).alias("starter_chance"), "pair_rows", "low_sample")
