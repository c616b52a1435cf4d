"""Payload sources, briefs and reviews: payloads are written from the given tables and read back by the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortrank.plans import features as P
from cohortrank.plans import workflow as V
from cohortrank.queries.adapters import AS_OF, EVENTS_SQL, OUTCOMES_SQL, UNITS_SQL, events, outcomes, table, units
from cohortrank.registry import query, round_up
from cohortrank.sources import files as L
from cohortrank.sources import payloads as Y

U, E = f"WITH {UNITS_SQL} ", f"WITH {EVENTS_SQL} "


def named(ident, name):
    return F.struct(F.col(ident).alias("id"), name.alias("name"))


def landed(df, item, *keys):
    """One payload per key, or per row: an array of items as JSON text."""
    return df.groupBy(*keys).agg(F.to_json(F.collect_list(item)).alias("body")) if keys else df.select(F.to_json(F.array(item)).alias("body"))


@query("SELECT l_orderkey AS fixture_id, CAST(l_linenumber AS BIGINT) AS time_elapsed, CAST(l_suppkey AS BIGINT) AS player_id, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey AS BIGINT) END AS assist_player_id, l_returnflag AS event_type, l_linestatus AS team FROM lineitem")
def event_payload_rows(spark, d):
    """An order's lines as its events; every third has no second entity."""
    item = F.struct(
        F.struct(F.col("l_linenumber").alias("elapsed")).alias("time"), F.struct(F.col("l_linestatus").alias("name")).alias("team"), named("l_suppkey", F.lit("s")).alias("player"),
        F.when(F.col("l_partkey") % 3 != 0, named("l_partkey", F.lit("p"))).alias("assist"), F.col("l_returnflag").alias("type"),
    )
    payloads = landed(table(spark, d, "lineitem"), item, F.col("l_orderkey").alias("fixture_id"))
    return Y.unit_events(payloads).select("fixture_id", "time_elapsed", "player_id", "assist_player_id", "event_type", "team")


@query("SELECT CAST(c_custkey AS BIGINT) AS player_id, c_name AS player_name, DATE '1980-01-01' + CAST(c_custkey % 7000 AS INT) AS birth_date, CAST(150 + c_custkey % 50 AS BIGINT) AS height_cm, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(60 + c_custkey % 40 AS BIGINT) END AS weight_kg, c_mktsegment AS current_team, CAST(c_nationkey AS BIGINT) AS current_league_id FROM customer WHERE c_custkey % 9 <> 0")
def entity_bios(spark, d):
    """Customers as bios; every ninth has no id and goes, every fourth no weight."""
    k = F.col("c_custkey")
    born = F.date_add(F.lit("1980-01-01").cast("date"), (k % 7000).cast("int")).cast("string")
    weight = F.when(k % 4 != 0, F.concat((60 + k % 40).cast("string"), F.lit(" KG")))
    person = F.struct(F.when(k % 9 != 0, k).alias("id"), F.col("c_name").alias("name"), F.struct(born.alias("date")).alias("birth"), F.concat((150 + k % 50).cast("string"), F.lit(" cm")).alias("height"), weight.alias("weight"))
    block = F.struct(F.struct(F.col("c_mktsegment").alias("name")).alias("team"), named("c_nationkey", F.lit("n")).alias("league"))
    other = F.struct(F.struct(F.lit("later").alias("name")).alias("team"), named("c_custkey", F.lit("n")).alias("league"))
    payloads = landed(table(spark, d, "customer"), F.struct(person.alias("player"), F.array(block, other).alias("statistics")))
    return Y.bios(payloads).select("player_id", "player_name", "birth_date", "height_cm", "weight_kg", "current_team", "current_league_id")


@query("SELECT CAST(o_custkey AS BIGINT) AS player_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS type, o_orderstatus AS team_in, CAST(o_orderkey AS BIGINT) AS team_in_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus || 'x' END AS team_out FROM orders")
def transfer_rows(spark, d):
    """A customer's orders as its moves."""
    out = F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.concat("o_orderstatus", F.lit("x")).alias("name")))
    move = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("type"), F.struct(named("o_orderkey", F.col("o_orderstatus")).alias("in"), out.alias("out")).alias("teams"))
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(move).alias("moves"))
    payloads = landed(held, F.struct(named("o_custkey", F.lit("c")).alias("player"), F.col("moves").alias("transfers")))
    return Y.transfers(payloads).select("player_id", "date", "type", "team_in", "team_in_id", "team_out")


@query("SELECT CAST(o_custkey AS BIGINT) AS player_id, o_orderpriority AS type, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) END AS end_date FROM orders")
def absence_rows(spark, d):
    """A customer's orders as its absences; every fourth is open."""
    end = F.when(F.col("o_orderkey") % 4 != 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")).cast("string")).otherwise("not known")
    item = F.struct(F.col("o_orderpriority").alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), end.alias("end"))
    return Y.absences(landed(table(spark, d, "orders"), item, F.col("o_custkey").cast("long").alias("player_id")))


@query("SELECT CAST(o_custkey AS BIGINT) AS player_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS fixture_id, o_orderpriority AS reason, CAST(o_orderdate AS DATE) AS date FROM orders")
def injury_rows(spark, d):
    """Orders as injuries; every third is tied to no unit and has a day of its own."""
    when = F.date_format("o_orderdate", "yyyy-MM-dd")
    unit = F.when(F.col("o_orderkey") % 3 != 0, F.struct(F.col("o_orderkey").alias("id"), F.concat(when, F.lit("T20:00:00+00:00")).alias("date")))
    item = F.struct(named("o_custkey", F.lit("c")).alias("player"), unit.alias("fixture"), F.col("o_orderpriority").alias("reason"), when.alias("date"))
    return Y.injuries(landed(table(spark, d, "orders"), item)).select("player_id", "fixture_id", "reason", "date")


FIXTURES = "SELECT CAST(o_orderkey AS INT) AS fixture_id, CAST(o_custkey % 25 AS INT) AS league_id, CAST(year(o_orderdate) AS VARCHAR) AS season, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS home_team, 'FT' AS status FROM orders WHERE o_orderstatus = 'F'"


@query(FIXTURES)
def completed_unit_rows(spark, d):
    """Orders as units in nested payloads; only completed ones count, and of two landings the later."""
    status = F.when(F.col("o_orderstatus") == "F", "FT").otherwise("NS")
    item = lambda home: F.struct(
        F.struct(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.struct(status.alias("short")).alias("status")).alias("fixture"),
        F.struct((F.col("o_custkey") % 25).alias("id"), F.year("o_orderdate").alias("season")).alias("league"), F.struct(F.struct(home.alias("name")).alias("home"), F.struct(F.lit("away").alias("name")).alias("away")).alias("teams"),
    )
    orders = table(spark, d, "orders")
    first, second = (landed(orders, item(home)).withColumn("seq", F.lit(k)) for k, home in enumerate((F.lit("old"), F.col("o_orderpriority"))))
    return L.completed_units(first.unionByName(second)).select("fixture_id", "league_id", "season", "date", "home_team", "status")


@query("SELECT CAST(l_orderkey AS BIGINT) AS fixture_id, CAST(count(*) AS DOUBLE) AS shots_total, round(100 * avg(l_discount), 2) AS possession, round(sum(l_tax), 2) AS expected_goals FROM lineitem GROUP BY 1")
def statistics_payload_rows(spark, d):
    """Sums of an order as {type, value} pairs of odd case; half of the orders name their expected goals 'xG'."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("fixture_id")).agg(F.count("*").alias("n"), F.round(100 * F.avg("l_discount"), 2).alias("p"), F.round(F.sum("l_tax"), 2).alias("x"))
    pair = lambda kind, value: F.struct(kind.alias("type"), value.cast("string").alias("value"))
    goals = F.when(F.col("fixture_id") % 2 == 0, F.lit("xG")).otherwise(F.lit("Expected Goals"))
    stats = F.array(pair(F.lit(" Total Shots"), F.col("n")), pair(F.lit("Ball Possession"), F.concat(F.col("p").cast("string"), F.lit("%"))), pair(goals, F.col("x")))
    payloads = g.select("fixture_id", F.to_json(F.array(F.struct(F.struct(F.lit("t").alias("name")).alias("team"), stats.alias("statistics")))).alias("body"))
    return L.team_statistics(payloads).select("fixture_id", "shots_total", "possession", "expected_goals")


@query("SELECT good, count(*) AS n FROM (SELECT coalesce(o_custkey % 7 > 0 AND trim(CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN 'nan' ELSE o_orderpriority END) NOT IN ('', 'nan'), false) AS good FROM orders) GROUP BY 1")
def reject_rows(spark, d):
    """Orders with an id or a name spoiled by rule go to the rejects."""
    k = F.col("o_orderkey")
    spoiled = table(spark, d, "orders").select((F.col("o_custkey") % 7).cast("string").alias("id"), F.when(k % 11 == 0, "  ").when(k % 13 == 0, "nan").otherwise(F.col("o_orderpriority")).alias("name"))
    good, bad = L.split_rejects(spoiled, ["id"], ["name"])
    return good.select(F.lit(True).alias("good")).unionAll(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_type || ' (' || p_brand || ')/%')), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def header_names(spark, d):
    text = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")/%"))
    return table(spark, d, "part").select("p_partkey", Y.plain_name(text).alias("name"))


@query(E + "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM e WHERE unit % 3 <> 1 GROUP BY 1")
def quality_filter(spark, d):
    """Every third check failed, every third was not made."""
    k = F.col("unit") % 3
    e = events(spark, d).withColumn("quality_check", F.when(k == 0, True).when(k == 1, False))
    return V.sound_rows(e).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(U + "SELECT cohort, period, count(*) AS n, count(*) FILTER (exposure >= 100) AS with_candidates, count(*) FILTER (exposure < 100) AS without_candidates, count(*) FILTER (label <> '5-LOW') AS with_team FROM u WHERE cohort = 3 GROUP BY 1, 2")
def review_counts(spark, d):
    """Units as review rows of one cohort: candidates where the exposure is large, a team but for the last label."""
    rows = units(spark, d).select("cohort", "period", F.when(F.col("exposure") >= 100, F.array("label")).otherwise(F.array().cast("array<string>")).alias("candidates"), F.when(F.col("label") != "5-LOW", F.col("label")).alias("team"))
    return V.review_summary(V.review_rows(rows, cohort=3), ["cohort", "period"])


@query("""SELECT o_orderkey, CAST((o_orderkey % 7 = 0)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey % 3 = 0)::INT AS INT) AS n_missing, o_orderkey % 2 = 0 AS pathway_open,
 o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 AS valid FROM orders""")
def brief_validation(spark, d):
    """Orders as briefs with fields left null, blank or empty by rule."""
    k = F.col("o_orderkey")
    briefs = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_orderpriority")).alias("role_name"), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("intent"),
        F.when(k % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("league_scope"), F.lit(20).alias("age_min"), F.when(k % 2 != 0, True).alias("pathway_check_done"),
    )
    return V.brief_problems(briefs, ["role_name", "intent", "league_scope", "age_min"]).select("o_orderkey", F.size("missing").alias("n_missing"), "pathway_open", "valid")


@query("SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (o_orderkey % 8 < 6) AS accepted FROM orders GROUP BY 1")
def override_validation(spark, d):
    """Orders as overrides; two reasons of eight are unknown or missing."""
    reasons = F.array(*map(F.lit, V.OVERRIDE_REASONS), F.lit("mood"), F.lit(None))
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.element_at(reasons, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("reason_category"))
    good, bad = V.split_overrides(o)
    both = good.withColumn("ok", F.lit(1)).unionByName(bad.withColumn("ok", F.lit(0)))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("ok") == 1).alias("accepted"))


@query(U + f""", lv AS (SELECT n_nationkey cohort, n_regionkey + 1 AS level FROM nation WHERE n_nationkey % 4 <> 0), cur AS (SELECT c_custkey entity, c_nationkey cohort FROM customer),
yr AS (SELECT entity, CAST(period AS DOUBLE) y, avg(m1) a FROM u GROUP BY 1, 2), sl AS (SELECT entity, CASE WHEN count(*) >= 2 THEN regr_slope(a, y) END s FROM yr GROUP BY 1),
rt AS (SELECT entity, avg(m1 / exposure * 90) FILTER (exposure >= 1) r1, avg(m3 / exposure * 90) FILTER (exposure >= 1) r3, arg_max(label, (ts, unit)) lb FROM u GROUP BY 1)
SELECT cur.entity, coalesce(upper(substr(lb, 1, 1)), 'U') AS position_group, CAST(coalesce(lv.level, 3) AS DOUBLE) AS level, greatest(0.0, round(date_diff('day', DATE '{AS_OF}', DATE '2000-01-01' + CAST(cur.entity % 1500 AS INT)) / 365.25, 2)) AS contract_years,
 rup(coalesce((r1 + r3) / 2, 0), 2) AS rate, rup(coalesce(s, 0), 2) AS trajectory FROM cur LEFT JOIN lv USING (cohort) LEFT JOIN rt USING (entity) LEFT JOIN sl USING (entity)""")
def value_model_rows(spark, d):
    levels = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("cohort"), (F.col("n_regionkey") + 1).alias("level"))
    start = F.lit("2000-01-01").cast("date")
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), start.alias("born"), F.col("c_nationkey").alias("cohort"), F.date_add(start, (F.col("c_custkey") % 1500).cast("int")).alias("contract_end"), F.col("c_acctbal").alias("value"))
    rows = P.value_rows(units(spark, d), current, levels, F.lit(AS_OF).cast("date"), ["m1", "m3"])
    return rows.select("entity", "position_group", "level", "contract_years", round_up("rate", 2).alias("rate"), round_up("trajectory", 2).alias("trajectory"))


@query(U + """, g AS (SELECT entity, cohort % 6 AS lvl, count(*) FILTER (label <> '5-LOW') st, count(*) n, count(*) FILTER (label = '2-HIGH') co, count(*) FILTER (label = '3-MEDIUM') it FROM u GROUP BY 1, 2),
c AS (SELECT c_custkey entity, CASE WHEN c_custkey % 10 = 0 THEN ' Wales' ELSE 'elsewhere' END nat, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 END tracked FROM customer),
p AS (SELECT c.entity, tracked, nat, n, CASE WHEN nat = ' Wales' THEN 15 WHEN coalesce(n, 0) = 0 THEN 0 ELSE
 CASE WHEN lvl <= 1 THEN CASE WHEN st / n >= 0.7 THEN 10 ELSE 8 END WHEN lvl = 2 THEN CASE WHEN st / n >= 0.7 THEN 8 ELSE 6 END WHEN lvl = 3 THEN CASE WHEN st / n >= 0.7 THEN 4 ELSE 2 END WHEN lvl = 4 THEN CASE WHEN st / n >= 0.5 THEN 2 ELSE 1 END ELSE 0 END
 + CASE WHEN tracked IS NULL THEN 0 WHEN co >= 10 THEN 5 WHEN co > 0 THEN 3 ELSE 0 END + CASE WHEN it >= 10 THEN 5 WHEN it >= 3 THEN 3 WHEN it > 0 THEN 1 ELSE 0 END END points FROM c LEFT JOIN g USING (entity))
SELECT entity, points, CASE WHEN points >= 15 THEN 'green' WHEN points >= 10 THEN 'amber' ELSE 'red' END AS status, CASE WHEN nat = ' Wales' THEN 0 WHEN coalesce(n, 0) = 0 THEN 1 WHEN tracked IS NULL THEN 1 ELSE 0 END AS n_gaps FROM p""")
def registration_points(spark, d):
    """Orders but the lowest priority as starts, two priorities as continental and international matches; every tenth
    customer is exempt, every third has no continental tracking."""
    k = F.col("c_custkey")
    seen = units(spark, d).groupBy("entity", (F.col("cohort") % 6).alias("level")).agg(F.count_if(F.col("label") != "5-LOW").alias("starts"), F.count("*").alias("appearances"), F.count_if(F.col("label") == "2-HIGH").alias("continental"), F.count_if(F.col("label") == "3-MEDIUM").alias("international"))
    named_ = table(spark, d, "customer").select(k.alias("entity"), F.when(k % 10 == 0, " Wales").otherwise("elsewhere").alias("nationality"))
    rows = named_.join(seen, "entity", "left").withColumn("continental", F.when(F.col("entity") % 3 != 0, F.col("continental")))
    rows = rows.withColumn("international", F.coalesce("international", F.lit(0)))
    return P.registration(rows).select("entity", "points", "status", F.size("gaps").alias("n_gaps"))


@query(f"WITH {OUTCOMES_SQL}" + """, w AS (SELECT o.*, d AS "window" FROM (SELECT *, DATE '2024-01-01' + CAST(entity % 300 AS INT) AS made FROM o) o JOIN (VALUES (DATE '2023-12-31'), (DATE '2024-03-01'), (DATE '2024-12-31')) v(d) ON made <= d),
k AS (SELECT *, rank() OVER (PARTITION BY "window" ORDER BY score) + (count(*) OVER (PARTITION BY "window", score) - 1) / 2.0 r, row_number() OVER (PARTITION BY "window" ORDER BY score DESC, entity) n FROM w),
a AS (SELECT "window", CASE WHEN sum(hit) > 0 AND sum(1 - hit) > 0 THEN (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * sum(1 - hit)) END auc, avg(hit) FILTER (n <= 20) p FROM k GROUP BY 1)
SELECT d AS "window", rup(auc, 4) AS auc, CASE WHEN auc IS NOT NULL THEN rup(p, 4) END AS precision FROM (VALUES (DATE '2023-12-31'), (DATE '2024-03-01'), (DATE '2024-12-31')) v(d) LEFT JOIN a ON a."window" = d""")
def backtest_windows(spark, d):
    """Outcomes dated by their id, over three windows, the first without any."""
    o = outcomes(spark, d).withColumn("made", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("entity") % 300).cast("int")))
    out = V.windowed_backtest(o, ["2023-12-31", "2024-03-01", "2024-12-31"], "made", "score", "hit", [F.desc("score"), "entity"])
    return out.select("window", round_up("auc", 4).alias("auc"), round_up("precision", 4).alias("precision"))


@query(f"WITH {OUTCOMES_SQL}" + """, w AS (SELECT o.*, least(1, score / 5000.0) AS p, d AS "window" FROM (SELECT *, DATE '2024-01-01' + CAST(entity % 300 AS INT) AS made FROM o) o JOIN (VALUES (DATE '2024-03-01'), (DATE '2024-12-31')) v(d) ON made <= d),
k AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY score, entity) AS r, count(*) OVER (PARTITION BY "window") AS n FROM w)
SELECT "window", CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((r - 1) * least(10, n) / (n - 1))) END AS INT) AS bin, count(*) AS n, rup(avg(p), 4) AS predicted, rup(avg(hit), 4) AS actual, rup(abs(avg(p) - avg(hit)), 9) > 0.05 AS alert FROM k GROUP BY 1, 2""")
def backtest_calibration(spark, d):
    """The calibration curve of each window over outcomes dated by their id."""
    o = outcomes(spark, d).withColumns({"made": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("entity") % 300).cast("int")), "p": F.least(F.lit(1.0), F.col("score") / 5000.0)})
    out = V.windowed_calibration(o, ["2024-03-01", "2024-12-31"], "made", "p", ["score", "entity"], "hit")
    return out.select("window", "bin", "n", round_up("predicted", 4).alias("predicted"), round_up("actual", 4).alias("actual"), "alert")


@query(E + """, n AS (SELECT entity, count(*) FILTER (event_type = 'view') c, bool_or(event_type = 'view' AND unit % 5 = 0) t, bool_or(event_type = 'view' AND (unit % 7 = 0 OR unit % 6 = 4 OR unit % 6 = 5)) f, count(*) FILTER (event_type = 'click') i FROM e GROUP BY 1),
m AS (SELECT entity, list_filter([CASE WHEN c < 3 THEN 'notes' END, CASE WHEN NOT t THEN 'top-6' END, CASE WHEN NOT f THEN 'system fit' END, CASE WHEN entity % 2 = 0 AND i < 6 THEN 'imports' END], lambda x: x IS NOT NULL) l FROM n)
SELECT entity, array_to_string(l, ';') AS missing, len(l) = 0 AS ready FROM m""")
def readiness_conditions(spark, d):
    """Views as notes and clicks as imports; every second entity is of an archetype that needs imports."""
    e = events(spark, d)
    k = F.col("unit")
    text = F.when(k % 5 == 0, "Seen at a TOP-6 side").otherwise("note")
    notes = e.where("event_type = 'view'").select("entity", F.concat_ws(", ", text, F.when(k % 7 == 0, F.lit("fits our System"))).alias("text"), (k % 6).alias("rating"))
    targets = e.select("entity", F.when(F.col("entity") % 2 == 0, "emerging_asset").otherwise("squad").alias("archetype")).distinct()
    out = V.readiness(targets, notes, e.where("event_type = 'click'").select("entity"))
    return out.select("entity", F.array_join("missing", ";").alias("missing"), "ready")
