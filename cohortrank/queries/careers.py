"""Careers and versioned references on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortrank.operators import merge as M
from cohortrank.plans import careers as P
from cohortrank.queries.adapters import AS_OF, UNITS_SQL, table, units
from cohortrank.queries.relational import r4
from cohortrank.registry import query
from cohortrank.storage import written_once

GROUPS = {"build": "central", "auto": "wide", "house": "front"}
CURVES = {"central": (25.0, 27.0), "wide": (24.0, 26.5), "front": (26.0, 29.0)}
BASE = f"WITH {UNITS_SQL}" + """, m AS (SELECT entity, unit, period, ts, (cohort + unit % 3) % 25 AS cohort, label AS team, CASE WHEN unit % 4 = 0 THEN 'Auto ' ELSE segment END AS position, exposure, m1, m3, status FROM u),
rt AS (SELECT * FROM m WHERE exposure >= 1), md AS (SELECT entity, period, team FROM (SELECT entity, period, team, row_number() OVER (PARTITION BY entity, period ORDER BY count(*) DESC, team) AS k FROM rt GROUP BY entity, period, team) WHERE k = 1),
mc AS (SELECT entity, period, cohort FROM (SELECT entity, period, cohort, row_number() OVER (PARTITION BY entity, period ORDER BY count(*) DESC, cohort) AS k FROM rt GROUP BY entity, period, cohort) WHERE k = 1),
se AS (SELECT entity, period, avg(m1 / exposure * 90) AS m1, avg(m3 / exposure * 90) AS m3 FROM rt GROUP BY 1, 2), sn AS (SELECT se.*, team, cohort, CASE WHEN cohort % 7 > 0 THEN cohort % 4 + 1 END AS tier, n_regionkey AS country FROM se LEFT JOIN md USING (entity, period) LEFT JOIN mc USING (entity, period) LEFT JOIN nation ON n_nationkey = cohort),
en AS (SELECT entity, CAST(min(ts) AS DATE) - 8000 - CAST(entity % 1500 AS INT) AS born, max_by(label, unit) AS team FROM u GROUP BY entity) """


def inputs(spark, d):
    u = written_once(units(spark, d), "units")
    matches = u.withColumns({"cohort": ((F.col("cohort") + F.col("unit") % 3) % 25).cast("int"), "team": F.col("label"), "position": F.when(F.col("unit") % 4 == 0, "Auto ").otherwise(F.col("segment"))})
    transfers = u.select("entity", F.when(F.col("status") == "P", "On Loan").when(F.col("status") == "F", "Free").alias("kind"), F.col("label").alias("team_in"), F.when(F.col("unit") % 5 == 0, "Elsewhere").otherwise("").alias("team_out"))
    entities = u.groupBy("entity").agg(F.date_sub(F.date_sub(F.to_date(F.min("ts")), 8000), (F.col("entity") % 1500).cast("int")).alias("born"), F.max_by("label", "unit").alias("team"))
    k = F.col("n_nationkey")
    leagues = table(spark, d, "nation").select(k.alias("cohort"), F.when(k % 7 > 0, k % 4 + 1).alias("tier"), F.col("n_regionkey").alias("country"))
    return matches, transfers, entities, leagues


@query(BASE + f""", h AS (SELECT entity, string_agg(period || ':' || coalesce(CAST(tier AS VARCHAR), '-'), ' ' ORDER BY period) AS tier_history, count(DISTINCT country) AS countries FROM sn GROUP BY 1),
lt AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS k FROM sn), ch AS (SELECT entity, ((max(m1) FILTER (k = 1) - max(m1) FILTER (k = 2)) + (max(m3) FILTER (k = 1) - max(m3) FILTER (k = 2))) / 2 AS change FROM lt GROUP BY 1),
st AS (SELECT entity, coalesce(min(k) FILTER (lt.team <> en.team) - 1, count(*)) AS stay FROM lt JOIN en USING (entity) GROUP BY 1),
tr AS (SELECT entity, count(*) FILTER (status = 'P') AS loans, bool_or(unit % 5 = 0) AS away FROM u GROUP BY 1), tt AS (SELECT entity, count(DISTINCT label) AS t FROM u GROUP BY 1),
po AS (SELECT entity, lower(trim(position)) AS label, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, lower(trim(position))) AS k FROM m GROUP BY entity, lower(trim(position))),
ag AS (SELECT entity, round(date_diff('day', born, DATE '{AS_OF}') / 365.25, 2) AS age, round(date_diff('day', born, CAST(f AS DATE)) / 365.25, 2) AS age_first FROM en JOIN (SELECT entity, min(ts) AS f FROM u GROUP BY 1) USING (entity)),
cu AS (SELECT entity, age, CASE WHEN contains(label, 'build') THEN 25.0 WHEN contains(label, 'auto') THEN 24.0 WHEN contains(label, 'house') THEN 26.0 END AS a, CASE WHEN contains(label, 'build') THEN 27.0 WHEN contains(label, 'auto') THEN 26.5 WHEN contains(label, 'house') THEN 29.0 END AS b FROM po JOIN ag USING (entity) WHERE k = 1)
SELECT entity, tier_history, loans, t + CAST(away AS INT) AS teams, countries, age_first, stay AS periods_at_team, rup(change, 3) AS change, CASE WHEN a IS NOT NULL THEN CASE WHEN ag.age < a THEN 'pre_peak' WHEN ag.age >= b THEN 'post_peak' ELSE 'peak' END END AS curve
FROM h JOIN ch USING (entity) JOIN st USING (entity) JOIN tr USING (entity) JOIN tt USING (entity) JOIN ag USING (entity) JOIN cu USING (entity)""")
def career_features(spark, d):
    from cohortrank.registry import round_up

    out = P.features(*inputs(spark, d), ["m1", "m3"], F.lit(AS_OF).cast("date"), GROUPS, CURVES)
    told = F.array_join(F.transform("tier_history", lambda x: F.concat(x["period"], F.lit(":"), F.coalesce(x["tier"].cast("string"), F.lit("-")))), " ")
    return out.withColumns({"tier_history": told, "change": round_up("change", 3)})


@query(BASE + """, i AS (SELECT entity, period, team, row_number() OVER (PARTITION BY entity ORDER BY period) - row_number() OVER (PARTITION BY entity, team ORDER BY period) AS g FROM sn)
SELECT entity, team, min(period) AS first, max(period) AS last, count(*) AS n FROM i WHERE team IS NOT NULL GROUP BY entity, team, g""")
def career_stints(spark, d):
    matches, *_ = inputs(spark, d)
    return P.stints(P.periods(matches, ["m1"]))


@query("""WITH h AS (SELECT p_brand AS name, p_type AS version, max(p_retailprice) AS weight, min(p_partkey) % 2 = 0 AS is_active, DATE '2020-01-01' AS valid_from, CASE WHEN min(p_partkey) % 2 = 1 THEN DATE '2021-01-01' END AS valid_to FROM part WHERE p_size < 30 GROUP BY 1, 2),
c AS (SELECT p_brand AS name, p_type AS version, max(p_retailprice) AS weight FROM part WHERE p_size >= 20 AND p_brand < 'Brand#20' GROUP BY 1, 2), j AS (
 SELECT coalesce(h.name, c.name) AS name, coalesce(h.version, c.version) AS version, h.name IS NOT NULL AS known, c.name IS NOT NULL AS live, h.weight AS old, c.weight AS new, is_active, valid_from, valid_to, coalesce(h.name, c.name) IN (SELECT name FROM c) AS named FROM h FULL JOIN c ON h.name = c.name AND h.version = c.version),
a AS (SELECT *, CASE WHEN NOT known THEN 'insert' WHEN live AND NOT is_active THEN 'reactivate' WHEN live AND old <> new THEN 'update' WHEN NOT live AND named AND is_active THEN 'close' ELSE 'same' END AS action FROM j)
SELECT name, version, CASE WHEN live THEN new ELSE old END AS weight, CASE WHEN action IN ('insert', 'reactivate') THEN true WHEN action = 'close' THEN false ELSE is_active END AS is_active, CASE WHEN action IN ('insert', 'reactivate') THEN DATE '2024-05-01' ELSE valid_from END AS valid_from,
 CASE WHEN action = 'close' THEN DATE '2024-05-01' WHEN action IN ('insert', 'reactivate') THEN NULL ELSE valid_to END AS valid_to, action FROM a""")
def versioned_sync(spark, d):
    part = table(spark, d, "part")
    key = [F.col("p_brand").alias("name"), F.col("p_type").alias("version")]
    odd = F.min("p_partkey") % 2 == 1
    day = lambda x: F.lit(x).cast("date")
    history = part.where("p_size < 30").groupBy(*key).agg(F.max("p_retailprice").alias("weight"), (~odd).alias("is_active"), F.min(day("2020-01-01")).alias("valid_from"), F.when(odd, F.min(day("2021-01-01"))).alias("valid_to"))
    current = part.where("p_size >= 20 AND p_brand < 'Brand#20'").groupBy(*key).agg(F.max("p_retailprice").alias("weight"))
    return M.versioned_sync(history, current, "name", "version", ["weight"], day("2024-05-01"))


@query("""WITH a AS (SELECT c_nationkey AS n, c_mktsegment AS s, min(c_custkey) AS v FROM customer GROUP BY 1, 2), b AS (SELECT s_nationkey AS n, min(s_suppkey) AS v FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_custkey END, CASE WHEN c_acctbal < -500 THEN a.v END, b.v) AS target FROM customer LEFT JOIN a ON a.n = c_nationkey AND a.s = c_mktsegment LEFT JOIN b ON b.n = c_nationkey""")
def two_walk_backfill(spark, d):
    """Null targets from a walk by nation and segment that knows few, then from one by nation."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.when(F.col("c_acctbal") < -500, F.col("c_mktsegment")).alias("s"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("target"))
    first = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), F.col("c_custkey").alias("v"))
    second = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("v"))
    return M.backfill_from_walks(c, [(first, ["n", "s"], "v"), (second, ["n"], "v")], "target").select("c_custkey", "target")
