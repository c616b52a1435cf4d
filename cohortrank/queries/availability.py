"""Availability on the star schema: an order is a unit, nation and priority make a team, lines are absence spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortrank.models import chances as C
from cohortrank.plans import availability as P
from cohortrank.plans.scoring import risk_tier
from cohortrank.queries.adapters import AS_OF, UNITS_SQL, table, units
from cohortrank.queries.relational import r4
from cohortrank.registry import query
from cohortrank.storage import written_once

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

BASE = f"WITH {UNITS_SQL}" + f""", m AS (SELECT entity, unit, period, ts, exposure, label, cohort || '/' || label AS team, status = 'P' AS substitute FROM u),
sd AS (SELECT DISTINCT * FROM (SELECT unit, period, team, CAST(ts AS DATE) AS day FROM m UNION ALL SELECT unit, period, (cohort + 1) % 25 || '/' || ({PRIORITIES!r})[unit % 5 + 1], CAST(ts AS DATE) FROM u)),
sp AS (SELECT o_custkey AS entity, CASE l_returnflag WHEN 'R' THEN 'Calf strain ' || l_linestatus WHEN 'A' THEN 'Knock' ELSE ' ' END AS kind,
 CASE WHEN l_quantity >= 5 THEN CAST(l_shipdate AS DATE) END AS start_day, CASE WHEN l_quantity <= 45 THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS end_day FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ab AS (SELECT entity, CAST(ts AS DATE) AS day FROM u WHERE status = 'F'),
tm AS (SELECT entity, period, team FROM (SELECT entity, period, team, row_number() OVER (PARTITION BY entity, period ORDER BY count(*) DESC, team) AS k FROM m GROUP BY entity, period, team) WHERE k = 1) """


def inputs(spark, d):
    """matches, schedule, spans, absences and changes."""
    u = written_once(units(spark, d).select("entity", "unit", "cohort", "period", "ts", "exposure", "label", "status"), "units")
    team = F.concat(F.col("cohort").cast("string"), F.lit("/"), F.col("label"))
    matches = u.select("entity", "unit", "period", "ts", "exposure", "label", team.alias("team"), (F.col("status") == "P").alias("substitute"))
    other = F.concat(((F.col("cohort") + 1) % 25).cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, PRIORITIES)), (F.col("unit") % 5 + 1).cast("int")))
    day = F.to_date("ts")
    schedule = u.select("unit", "period", F.explode(F.array_distinct(F.array(team, other))).alias("team"), day.alias("day")).distinct()
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    ship, quantity = F.to_date("l_shipdate"), F.col("l_quantity")
    kind = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Calf strain "), "l_linestatus")).when(F.col("l_returnflag") == "A", "Knock").otherwise(" ")
    spans = lines.select(
        F.col("o_custkey").alias("entity"), kind.alias("kind"),
        F.when(quantity >= 5, ship).alias("start_day"), F.when(quantity <= 45, F.date_add(ship, quantity.cast("int"))).alias("end_day"),
    )
    absences = u.where("status = 'F'").select("entity", day.alias("day"))
    changes = lines.select(F.col("o_custkey").alias("entity"), F.col("l_orderkey").alias("unit"), F.when(F.col("l_returnflag") == "R", "Substitution 1").otherwise("Card").alias("event"), F.when(quantity <= 45, quantity * 2).alias("elapsed"))
    return matches, schedule, spans, absences, changes


FEATURES = BASE + f""", tc AS (SELECT team, period, count(DISTINCT unit) AS n FROM sd GROUP BY ALL), ow AS (SELECT entity, period, count(*) FILTER (NOT substitute) AS starts, count(DISTINCT unit) AS own, min(ts) AS first FROM m GROUP BY ALL),
pr AS (SELECT entity, period, starts / coalesce(n, own) AS rate, row_number() OVER (PARTITION BY entity ORDER BY first DESC, period DESC) AS k FROM ow LEFT JOIN tm USING (entity, period) LEFT JOIN tc USING (team, period)),
ba AS (SELECT entity, max(rate) FILTER (k = 1) AS rate, avg(rate) FILTER (k <= 3) AS rate_3 FROM pr GROUP BY 1),
re AS (SELECT *, greatest(date_diff('day', coalesce(start_day, coalesce(end_day, DATE '{AS_OF}')), coalesce(end_day, DATE '{AS_OF}')), 0) AS days, nullif(lower(trim(kind)), '') AS lab FROM sp WHERE start_day IS NULL OR start_day >= DATE '{AS_OF}' - 1095),
su AS (SELECT entity, count(*) AS episodes, avg(days) AS mean_days, max(days) AS max_days, count(*) FILTER (contains(lower(kind), 'calf')) AS muscle, (count(lab) - count(DISTINCT lab)) / nullif(count(lab), 0) AS repeat_share, max(end_day) AS le FROM re GROUP BY 1),
an AS (SELECT entity, max(day) AS la FROM ab WHERE day >= DATE '{AS_OF}' - 1095 GROUP BY 1),
kk AS (SELECT entity, exposure, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, unit DESC) AS k FROM m), st AS (SELECT entity, coalesce(min(k) FILTER (NOT exposure >= 60) - 1, count(*)) AS continuity FROM kk GROUP BY 1),
ea AS (SELECT DISTINCT l_orderkey AS unit FROM lineitem WHERE l_returnflag = 'R' AND l_quantity * 2 < 80), tf AS (SELECT entity, count(ea.unit) / count(*) AS taken_off FROM m LEFT JOIN ea USING (unit) WHERE NOT substitute GROUP BY 1) """


@query(FEATURES + f"""SELECT entity, rup(rate, 4) AS rate, rup(rate_3, 4) AS rate_3, coalesce(episodes, 0) AS episodes, rup(mean_days, 4) AS mean_days, max_days, coalesce(muscle, 0) AS muscle, rup(repeat_share, 4) AS repeat_share,
 CASE WHEN le IS NULL AND la IS NULL THEN NULL ELSE date_diff('day', greatest(le, la), DATE '{AS_OF}') END AS days_since, continuity, rup(taken_off, 4) AS taken_off
FROM ba LEFT JOIN su USING (entity) LEFT JOIN an USING (entity) LEFT JOIN st USING (entity) LEFT JOIN tf USING (entity)""")
def availability_spans(spark, d):
    out = P.features(*inputs(spark, d), F.lit(AS_OF).cast("date"))
    return out.select("entity", r4(F.col("rate"), "rate"), r4(F.col("rate_3"), "rate_3"), "episodes", r4(F.col("mean_days"), "mean_days"), "max_days", "muscle", r4(F.col("repeat_share"), "repeat_share"), "days_since", "continuity", r4(F.col("taken_off"), "taken_off"))


@query(BASE + f""", cl AS (SELECT entity, coalesce(start_day, end_day, DATE '{AS_OF}') AS a, coalesce(end_day, DATE '{AS_OF}') AS b, count(*) AS c FROM sp GROUP BY ALL), dc AS (SELECT team, period, day, count(*) AS n FROM sd GROUP BY ALL),
th AS (SELECT entity, a, b, sum(n) AS n FROM cl JOIN tm USING (entity) JOIN dc USING (team, period) WHERE day BETWEEN a AND b GROUP BY ALL),
pl AS (SELECT m.entity, sd.day, count(*) AS n FROM m JOIN tm ON tm.entity = m.entity AND tm.period = m.period JOIN sd ON sd.unit = m.unit AND sd.team = tm.team AND sd.period = m.period WHERE exposure > 0 GROUP BY ALL),
tk AS (SELECT entity, a, b, sum(n) AS n FROM cl JOIN pl USING (entity) WHERE day BETWEEN a AND b GROUP BY ALL)
SELECT entity, CAST(sum(c) AS BIGINT) AS spans, CAST(sum(c * (coalesce(th.n, 0) - coalesce(tk.n, 0))) AS BIGINT) AS missed, CAST(max(coalesce(th.n, 0) - coalesce(tk.n, 0)) AS BIGINT) AS most FROM cl LEFT JOIN th USING (entity, a, b) LEFT JOIN tk USING (entity, a, b) GROUP BY 1""")
def availability_missed(spark, d):
    matches, schedule, spans, *_ = inputs(spark, d)
    out = P.units_missed(spans, matches, schedule, F.lit(AS_OF).cast("date"))
    return out.groupBy("entity").agg(F.count("*").alias("spans"), F.sum("missed").alias("missed"), F.max("missed").alias("most"))


@query(BASE + """, se AS (SELECT entity, period, count(*) FILTER (NOT substitute) AS starts, count(*) AS n, sum(exposure) AS x, max(team) AS team, max(label) AS label FROM m GROUP BY 1, 2 HAVING count(*) >= 2),
tc AS (SELECT team, period, count(*) AS c FROM sd GROUP BY ALL), ra AS (SELECT se.*, lead(starts / coalesce(c, n)) OVER w AS ns FROM se LEFT JOIN tc USING (team, period) WINDOW w AS (PARTITION BY entity ORDER BY period)),
rw AS (SELECT entity, period, label, make_date(CAST(period AS INT), 12, 31) AS ref, CAST(ns >= 0.02 AS INT) AS target FROM ra WHERE ns IS NOT NULL),
ep AS (SELECT entity, period, greatest(date_diff('day', start_day, coalesce(end_day, ref)), 0) AS days, kind, nullif(lower(trim(kind)), '') AS lab, end_day FROM rw JOIN sp USING (entity) WHERE start_day >= ref - 1095),
su AS (SELECT entity, period, count(*) AS episodes, avg(days) AS mean_days, max(days) AS max_days, count(*) FILTER (contains(lower(kind), 'calf')) AS muscle, (count(lab) - count(DISTINCT lab)) / nullif(count(lab), 0) AS repeat_share, max(end_day) AS le FROM ep GROUP BY 1, 2),
an AS (SELECT entity, period, max(day) AS la FROM rw JOIN ab USING (entity) WHERE day >= ref - 1095 GROUP BY 1, 2),
pa AS (SELECT rw.entity, rw.period, se.starts / se.n AS sh, x / se.n AS mx, row_number() OVER (PARTITION BY rw.entity, rw.period ORDER BY se.period DESC) AS k FROM rw JOIN se ON se.entity = rw.entity AND se.period <= rw.period AND CAST(se.period AS INT) >= year(ref - 1095)),
hs AS (SELECT entity, period, avg(sh) AS rate, coalesce(min(k) FILTER (NOT mx >= 60) - 1, count(*)) AS continuity FROM pa GROUP BY 1, 2), bo AS (SELECT entity, CAST(min(ts) AS DATE) - 7000 AS born FROM u GROUP BY 1)
SELECT entity, period, rup(rate, 4) AS rate, coalesce(episodes, 0) AS episodes, rup(mean_days, 4) AS mean_days, max_days, coalesce(muscle, 0) AS muscle, rup(repeat_share, 4) AS repeat_share,
 CASE WHEN le IS NULL AND la IS NULL THEN NULL ELSE date_diff('day', greatest(le, la), ref) END AS days_since, continuity, round(date_diff('day', born, ref) / 365.25, 2) AS age, upper(substr(label, 1, 1)) AS position_group, target
FROM rw LEFT JOIN su USING (entity, period) LEFT JOIN an USING (entity, period) LEFT JOIN hs USING (entity, period) LEFT JOIN bo USING (entity)""")
def forward_availability(spark, d):
    matches, schedule, spans, absences, _ = inputs(spark, d)
    born = matches.groupBy("entity").agg(F.date_sub(F.to_date(F.min("ts")), 7000).alias("born"))
    out = P.training_rows(matches, schedule, spans, absences, born, least_units=2, target=0.02)
    return out.select("entity", "period", r4(F.col("rate"), "rate"), "episodes", r4(F.col("mean_days"), "mean_days"), "max_days", "muscle", r4(F.col("repeat_share"), "repeat_share"), "days_since", "continuity", "age", "position_group", "target")


@query(FEATURES + f""", x AS (SELECT entity, coalesce(nullif(rate_3, 0), nullif(rate, 0), 0.7) AS sh, coalesce(episodes, 0) AS ep, coalesce(repeat_share, 0) AS rs, coalesce(max_days, 0) AS mx, continuity AS co, greatest(le, la) AS last FROM ba LEFT JOIN su USING (entity) LEFT JOIN an USING (entity) LEFT JOIN st USING (entity)),
v AS (SELECT entity, (sh - 0.5) * 0.38 AS f0, -0.035 * ep AS f1, -0.14 * rs AS f2, -0.0015 * mx AS f3, least(co, 10) * 0.018 AS f4, CASE WHEN last IS NULL THEN 0 ELSE least(date_diff('day', last, DATE '{AS_OF}'), 180) / 180.0 * 0.08 END AS f5, sh FROM x),
w AS (SELECT entity, unnest(['rate', 'episodes', 'repeats', 'longest', 'continuity', 'days_since']) AS factor, unnest([0, 1, 2, 3, 4, 5]) AS place, unnest([f0, f1, f2, f3, f4, f5]::DOUBLE[]) AS f FROM v),
t AS (SELECT entity, factor, row_number() OVER (PARTITION BY entity ORDER BY abs(rup(f, 9)) DESC, place) AS k FROM w)
SELECT entity, rup(chance, 4) AS chance, CASE WHEN rup(1 - chance, 9) > 0.4 THEN 'High' WHEN rup(1 - chance, 9) > 0.2 THEN 'Medium' ELSE 'Low' END AS tier, factors
FROM (SELECT entity, rup(least(greatest(0.52 + 0.38 * sh + f1 + f2 + f3 + f4 + f5, 0.2), 0.95), 9) AS chance FROM v) JOIN (SELECT entity, string_agg(factor, ',' ORDER BY k) AS factors FROM t WHERE k <= 5 GROUP BY 1) USING (entity)""")
def availability_rule(spark, d):
    """The rule for sparse histories, on absence spans."""
    f = P.features(*inputs(spark, d), F.lit(AS_OF).cast("date"))
    told = C.rule(*(F.col(c) for c in ("rate_3", "rate", "episodes", "repeat_share", "max_days", "continuity", "days_since")))
    out = f.select("entity", told["chance"].alias("chance"), told["factors"].alias("factors"))
    return out.select("entity", r4(F.col("chance"), "chance"), risk_tier(F.col("chance")).alias("tier"), F.array_join(F.transform("factors", lambda p: p["factor"]), ",").alias("factors"))


NUMBERS = ["rate", "episodes", "mean_days", "max_days", "muscle", "repeat_share", "days_since", "continuity", "age"]


@query()
def availability_risk(spark, d):
    """Chance to be available by a model learned from the entities' own periods, by the rule where a history is sparse."""
    matches, schedule, spans, absences, changes = inputs(spark, d)
    born = matches.groupBy("entity").agg(F.date_sub(F.to_date(F.min("ts")), 7000).alias("born"))
    seen = written_once(P.training_rows(matches, schedule, spans, absences, born, least_units=2, target=0.02, before_ref=True), "seen")
    model = C.fitted(seen, NUMBERS, ["position_group"], "target")
    label = matches.groupBy("entity").agg(F.upper(F.substring(F.max_by("label", F.struct("ts", "unit")), 1, 1)).alias("position_group"))
    f = P.features(matches, schedule, spans, absences, changes, F.lit(AS_OF).cast("date")).withColumn("latest", F.col("rate")).withColumn("rate", F.col("rate_3"))
    f = f.join(label, "entity", "left").join(born, "entity", "left").withColumn("age", F.round(F.datediff(F.lit(AS_OF).cast("date"), "born") / 365.25, 2)).drop("born")
    told = C.rule(*(F.col(c) for c in ("rate", "latest", "episodes", "repeat_share", "max_days", "continuity", "days_since")))
    f = f.withColumns({"_rule": told["chance"], "_why": told["factors"], "sparse": C.sparse(*(F.col(c) for c in ("episodes", "muscle", "max_days", "repeat_share")))})
    out = C.chances(f, model, NUMBERS, ["position_group"])
    chosen = out.select("entity", F.when(F.col("sparse"), F.col("_rule")).otherwise(F.col("chance")).alias("chance"), F.when(F.col("sparse"), F.col("_why")).otherwise(F.col("factors")).alias("factors"), F.when(F.col("sparse"), "rule").otherwise("model").alias("source"))
    return chosen.select("entity", F.round("chance", 6).alias("chance"), risk_tier(F.col("chance")).alias("tier"), F.transform("factors", lambda p: F.struct(p["factor"].alias("factor"), F.round(p["value"], 6).alias("value"))).alias("factors"), "source")


@query()
def shot_chances(spark, d):
    """Lines as shots: chances from a fit on grouped counts, summed by entity and period beside the hits."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_suppkey").alias("entity"), F.year("o_orderdate").cast("string").alias("period"), F.round(F.col("l_quantity") / 5).alias("distance"), F.round(F.col("l_discount") * 100).alias("angle"), F.col("l_returnflag").alias("state"),
        (F.col("l_tax") * 100 + F.col("l_quantity") / 25 >= 5).cast("int").alias("hit"),
    )
    model = C.fitted(lines, ["distance", "angle"], ["state"], "hit")
    # chances depend on the features alone, so they are computed once for each of their combinations
    shots = lines.groupBy("entity", "period", "distance", "angle", "state").agg(F.count("*").alias("shots"), F.sum("hit").alias("hits"))
    rated = C.chances(shots, model, ["distance", "angle"], ["state"])
    return rated.groupBy("entity", "period").agg(F.sum("shots").alias("shots"), F.sum("hits").alias("hits"), F.round(F.sum(F.col("chance") * F.col("shots")), 4).alias("expected"))
