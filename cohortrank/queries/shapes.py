"""Joins, aggregates, windows, tops and set operations on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.operators import aggregates as A
from cohortrank.operators import joins as J
from cohortrank.operators import names as K
from cohortrank.operators import windows as N
from cohortrank.queries.adapters import AS_OF, EVENTS_AS_OF, EVENTS_SQL, OUTCOMES_SQL, SNAPSHOTS_SQL, SUPPLY_SQL, UNITS_SQL, events, outcomes, snapshots, supply, table, units
from cohortrank.queries.relational import r4
from cohortrank.registry import query, round_up
from cohortrank.storage import written_once

U, E, SU, SN, O = (f"WITH {x} " for x in (UNITS_SQL, EVENTS_SQL, SUPPLY_SQL, SNAPSHOTS_SQL, OUTCOMES_SQL))


# joins

@query("SELECT o_orderpriority, count(*) n, round(sum(l_extendedprice), 2) total FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def inner_join(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey")
def left_enrich(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_custkey % 5 <> 0"), F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998)")
def semi_join(spark, d):
    recent = table(spark, d, "orders").where(F.year("o_orderdate") == 1998)
    return table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998)")
def anti_join(spark, d):
    recent = table(spark, d, "orders").where(F.year("o_orderdate") == 1998)
    return table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("""SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_returned FROM orders LEFT JOIN (SELECT l_orderkey k, count(*) n FROM lineitem GROUP BY 1) a ON a.k = o_orderkey
LEFT JOIN (SELECT l_orderkey k, count(*) r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.k = o_orderkey""")
def left_join_counts(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    out = table(spark, d, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("r", F.lit(0)).alias("n_returned"))


@query(SN + "SELECT unit, n.position FROM u ASOF LEFT JOIN n ON n.cohort = u.cohort AND CAST(u.ts AS DATE) >= n.day")
def asof_snapshot(spark, d):
    u = units(spark, d).select("unit", "cohort", F.to_date("ts").alias("day_at"))
    return J.asof_join(u, snapshots(spark, d), ["cohort"], "day_at", "day", ["position"], span=lambda t: F.date_trunc("month", t)).select("unit", "position")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) k FROM orders) WHERE k = 1")
def latest_per_key(spark, d):
    return J.latest_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, count(*) n, sum(CAST(l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AS INT) + CAST(l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AS INT)) AS sides FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1")
def either_side_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    hits = J.either_side_join(li, ["l_partkey", "l_suppkey"], table(spark, d, "part").where("p_size = 7"), "p_partkey")
    return hits.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("matched_sides").alias("sides"))


def keyed_names(df, name, id_name, id_col, block):
    """id, name key and block columns. Keys are written once, as folding runs in Python."""
    from cohortrank.functions import scalars as S

    return written_once(df.select(F.col(id_col).alias(id_name), S.text_key(F.col(name)).alias("name"), *block), "keys")


@query()
def unit_reconcile(spark, d):
    """Units of two sources matched by equal day and best name similarity of at least 0.65, through the day's index of words."""
    from cohortrank.functions import scalars as S

    e = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumns({"day": F.to_date("o_orderdate"), "other": F.concat(F.lower("c_name"), F.lit(" fc"))})
    a, b = keyed_names(e, "other", "a", "o_orderkey", ["day"]), keyed_names(e, "c_name", "b", "o_orderkey", ["day"])
    return K.best_names(a, b, "a", "b", ["day"], S.name_similarity, 0.65).select("a", "b", "score")


def resolution_sources(spark, d):
    """Perturbed names as records, the customers as entities, and a saved cross-walk."""
    c = table(spark, d, "customer").withColumns({"cohort": F.col("c_nationkey"), "segment": F.col("c_mktsegment")})
    entities = keyed_names(c, "c_name", "entity_id", "c_custkey", ["cohort", "segment"])
    twisted = F.when(F.col("c_custkey") % 3 == 0, F.translate(F.lower("c_name"), "#", " ")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("cstomer "), F.substring("c_name", -9, 9))).otherwise(F.concat(F.col("c_name"), F.lit("x")))
    asked = c.withColumns({"twisted": twisted, "cohort": F.when(F.col("c_custkey") % 8 != 0, F.col("c_nationkey"))})
    return keyed_names(asked, "twisted", "record", "c_custkey", ["cohort", "segment"]), entities, table(spark, d, "customer").where("c_custkey % 12 = 0").select(F.col("c_custkey").alias("entity_id"))


@query()
def entity_resolution(spark, d):
    """Perturbed names: saved cross-walk, then names within the nation, then within the segment, each by surname and initial,
    surname, rarest words and rarest runs of characters."""
    from cohortrank.functions import scalars as S

    records, entities, walk = resolution_sources(spark, d)
    saved = lambda left: left.join(walk.hint("merge"), F.col("record") == F.col("entity_id")).select("record", "entity_id", F.lit(1.0).alias("score"))
    within = lambda block: lambda left: K.best_names(left, entities, "record", "entity_id", [block], S.source_similarity, 0.72, surnames=True)
    return J.resolve_in_stages(records, "record", [saved, within("cohort"), within("segment")])


@query("""WITH p AS (SELECT a.c_custkey a, b.c_custkey b, CASE WHEN a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment THEN 1 WHEN a.c_nationkey = b.c_nationkey THEN 2 ELSE 3 END tier
 FROM (SELECT * FROM customer WHERE c_custkey % 5 = 0) a JOIN customer b ON a.c_custkey // 10 = b.c_custkey // 10 AND a.c_custkey <> b.c_custkey)
SELECT a, b, CAST(tier AS INT) AS tier, CASE tier WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 ELSE 0.5 END AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY tier, b) k FROM p) WHERE k = 1""")
def tiered_match(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_custkey") / 10).alias("block"))
    a = c.where("c_custkey % 5 = 0").select("block", F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("na"), F.col("c_mktsegment").alias("sa"))
    pairs = a.join(c.withColumnRenamed("c_custkey", "b"), "block").where("a <> b")
    same = F.col("na") == F.col("c_nationkey")
    rules = [(same & (F.col("sa") == F.col("c_mktsegment")), 0.95), (same, 0.9), (F.lit(True), 0.5)]
    return J.tiered_match(pairs, "a", rules, ["b"]).select("a", "b", "tier", "match_score")


@query("""WITH p AS (SELECT a.c_custkey a, b.c_custkey b, CASE WHEN a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment THEN 1 WHEN a.c_nationkey = b.c_nationkey THEN 2 WHEN a.c_mktsegment = b.c_mktsegment THEN 3 END tier
 FROM customer a JOIN customer b ON a.c_custkey // 10 = b.c_custkey // 10 AND a.c_custkey <> b.c_custkey)
SELECT a, b, CAST(tier AS INT) AS tier, CASE tier WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 ELSE 0.5 END AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY tier, b) k FROM p WHERE tier IS NOT NULL) WHERE k = 1""")
def tiered_match_all(spark, d):
    """Every customer against the others of its block of ten; those that meet no rule are left out."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_custkey") / 10).alias("block"))
    a = c.select("block", F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("na"), F.col("c_mktsegment").alias("sa"))
    pairs = a.join(c.withColumnRenamed("c_custkey", "b"), "block").where("a <> b")
    nation, segment = F.col("na") == F.col("c_nationkey"), F.col("sa") == F.col("c_mktsegment")
    return J.tiered_match(pairs, "a", [(nation & segment, 0.95), (nation, 0.9), (segment, 0.5)], ["b"]).select("a", "b", "tier", "match_score")


@query("""WITH g AS (SELECT p_partkey // 3 AS block, p_partkey, 0.70 + (p_partkey * p_partkey * 13 % 31) / 100.0 AS score FROM part), k AS (SELECT *, row_number() OVER w r, lead(score) OVER w AS second_score FROM g WINDOW w AS (PARTITION BY block ORDER BY score DESC, p_partkey))
SELECT block, p_partkey, score, second_score, (score >= 0.98 OR (score >= 0.85 AND (second_score IS NULL OR rup(score - second_score, 9) >= 0.05))) AS accepted FROM k WHERE r = 1""")
def top2_within_limits(spark, d):
    """The best of each three parts, sure from 0.98 on, else from 0.85 on if it leads by 0.05."""
    k = F.col("p_partkey")
    g = table(spark, d, "part").select(F.floor(k / 3).alias("block"), "p_partkey", (0.70 + (k * k * 13 % 31) / 100.0).alias("score"))
    return J.top2_gap(g, "block", "p_partkey", "score", 0.85, 0.98, 0.05).select("block", "p_partkey", "score", "second_score", "accepted")


@query(U + """, g AS (SELECT cohort, segment, round(sum(m1), 2) s FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w r, lead(s) OVER w s2 FROM g WINDOW w AS (PARTITION BY cohort ORDER BY s DESC, segment))
SELECT cohort, segment, s AS score, s2 AS second_score, (s2 IS NULL OR s - s2 >= 0.05 * s2) AS accepted FROM k WHERE r = 1""")
def top2_gap_accept(spark, d):
    g = units(spark, d).groupBy("cohort", "segment").agg(F.round(F.sum("m1"), 2).alias("score"))
    best = J.top2_gap(g, "cohort", "segment", "score", 0.0, float("inf"), 0.0)
    clear = F.col("second_score").isNull() | (F.col("score") - F.col("second_score") >= 0.05 * F.col("second_score"))
    return best.withColumn("accepted", F.col("accepted") & clear)


@query("""SELECT a AS o_orderkey, b AS nearest, gap AS gap_days FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY gap, b) k FROM (
 SELECT x.o_orderkey a, y.o_orderkey b, CAST(abs(date_diff('day', CAST(x.o_orderdate AS DATE), CAST(y.o_orderdate AS DATE))) AS INT) gap FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey) WHERE gap <= 60) WHERE k = 1""")
def nearest_date_match(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    other = o.select("o_custkey", F.col("o_orderkey").alias("nearest"), F.col("o_orderdate").alias("other_date"))
    return J.nearest_within(o, other, "o_custkey", "o_orderdate", "other_date", 60, "o_orderkey", "nearest").select("o_orderkey", "nearest", "gap_days")


@query(SU + """, g AS (SELECT entity, period, max(segment) segment, round(sum(exposure), 2) x FROM s GROUP BY 1, 2), t AS (SELECT *, lead(period) OVER w np, lead(segment) OVER w ns, lead(x) OVER w nx FROM g WINDOW w AS (PARTITION BY entity ORDER BY period))
SELECT entity, period, np AS next_period, x, nx AS next_x FROM t WHERE np IS NOT NULL AND x >= 540 AND nx >= 450""")
def period_transition(spark, d):
    g = supply(spark, d).groupBy("entity", "period").agg(F.max("segment").alias("segment"), F.round(F.sum("exposure"), 2).alias("x"))
    return J.period_transition(g, "entity", ["period"], ["period", "segment", "x"]).where("x >= 540 AND next_x >= 450").select("entity", "period", "next_period", "x", "next_x")


# aggregates

@query(U + "SELECT entity, period, cohort, round(sum(coalesce(m1, 0)), 2) s1, rup(avg(m2), 4) a2, sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) f, max(label) top FROM u GROUP BY 1, 2, 3 HAVING sum(exposure) > 100")
def season_aggregate(spark, d):
    g = units(spark, d).groupBy("entity", "period", "cohort").agg(F.round(F.sum(F.coalesce("m1", F.lit(0.0))), 2).alias("s1"), r4(F.avg("m2"), "a2"), F.count_if(F.col("status") == "F").alias("f"), F.max("label").alias("top"), F.sum("exposure").alias("x"))
    return g.where("x > 100").drop("x")


@query(U + ", c AS (SELECT entity, label, count(*) n FROM u GROUP BY 1, 2) SELECT entity, a AS mean_rate, label AS mode_label FROM (SELECT entity, rup(avg(m1 / exposure * 90), 4) a FROM u WHERE exposure >= 1 GROUP BY 1) JOIN (SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) k FROM c) USING (entity) WHERE k = 1")
def entity_mean_mode(spark, d):
    u = A.per_exposure(units(spark, d), ["m1"])
    return u.groupBy("entity").agg(r4(F.avg("m1_rate"), "mean_rate")).join(A.modal(units(spark, d), ["entity"], "label", "mode_label"), "entity")


@query(U + "SELECT cohort, period, label FROM (SELECT cohort, period, label, row_number() OVER (PARTITION BY cohort, period ORDER BY count(*) DESC, label) k FROM u GROUP BY 1, 2, 3) WHERE k = 1")
def modal_value(spark, d):
    return A.modal(units(spark, d), ["cohort", "period"], "label")


@query(U + "SELECT cohort, period, count(*) n, count(DISTINCT entity) entities FROM u GROUP BY 1, 2")
def coverage_counts(spark, d):
    return units(spark, d).groupBy("cohort", "period").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


@query("SELECT 'customer' AS name, count(*) n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def table_totals(spark, d):
    one = lambda t: table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return one("customer").unionByName(one("orders")).unionByName(one("lineitem")).unionByName(one("events"))


@query("SELECT c_nationkey, count(*) n, round(100.0 * count(*) FILTER (c_acctbal > 0) / nullif(count(*), 0), 1) positive_pct FROM customer GROUP BY 1")
def filtered_coverage(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("c_acctbal") > 0) / F.count("*"), 1).alias("positive_pct"))


@query(U + "SELECT entity, period, CASE WHEN sum(exposure) > 0 THEN rup(sum(m1) * 90 / sum(exposure), 2) END AS rate FROM u GROUP BY 1, 2")
def ratio_of_sums(spark, d):
    return units(spark, d).groupBy("entity", "period").agg(round_up(F.when(F.sum("exposure") > 0, F.sum("m1") * 90 / F.sum("exposure")), 2).alias("rate"))


@query(U + "SELECT entity, rup(sum(CASE WHEN status <> 'F' THEN m3 END) / nullif(sum(CASE WHEN status <> 'F' THEN m1 END), 0), 4) AS ratio FROM u GROUP BY 1")
def paired_ratio(spark, d):
    return units(spark, d).groupBy("entity").agg(r4(A.ratio_of_sums(F.when(F.col("status") != "F", F.col("m3")), F.col("m1")), "ratio"))


@query(U + "SELECT cohort, rup(avg(m1) FILTER (label LIKE '1%'), 4) p1, rup(avg(m1) FILTER (label LIKE '2%'), 4) p2, rup(avg(m1) FILTER (label LIKE '3%'), 4) p3, rup(avg(m1) FILTER (label LIKE '4%'), 4) p4 FROM u GROUP BY 1")
def pivot_mean(spark, d):
    p = units(spark, d).withColumn("b", F.concat(F.lit("p"), F.substring("label", 1, 1))).groupBy("cohort").pivot("b", ["p1", "p2", "p3", "p4"]).avg("m1")
    return p.select("cohort", *(r4(F.col(c), c) for c in ("p1", "p2", "p3", "p4")))


@query(U + "SELECT entity, rup(avg(CAST(status = 'O' AS INT)), 4) AS share FROM u GROUP BY 1")
def share_of(spark, d):
    return units(spark, d).groupBy("entity").agg(r4(F.avg((F.col("status") == "O").cast("int")), "share"))


@query("SELECT s_nationkey, count(DISTINCT k) n FROM (SELECT s_nationkey, 'p' || l_partkey k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT s_nationkey, 's' || l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1")
def distinct_union_count(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    keys = F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    return j.select("s_nationkey", F.explode(keys).alias("k")).groupBy("s_nationkey").agg(F.count_distinct("k").alias("n"))


@query(E + "SELECT entity, rup(sum(greatest(c - 1, 0)) / sum(c), 4) AS repeat_share FROM (SELECT entity, event_type, count(*) c FROM e GROUP BY 1, 2) GROUP BY 1")
def repeat_share(spark, d):
    return A.repeat_share(events(spark, d), ["entity"], "event_type").select("entity", r4(F.col("repeat_share"), "repeat_share"))


@query(E + f", x AS (SELECT entity, CAST(ts AS DATE) a, lead(CAST(ts AS DATE)) OVER (PARTITION BY entity ORDER BY ts, unit) b FROM e WHERE event_type = 'error') SELECT entity, rup(avg(t), 4) mean_days, CAST(max(t) AS INT) max_days, count(*) n FROM (SELECT entity, greatest(date_diff('day', a, coalesce(b, DATE '{EVENTS_AS_OF}')), 0) t FROM x) GROUP BY 1")
def duration_stats(spark, d):
    x = events(spark, d).where("event_type = 'error'").withColumn("a", F.to_date("ts"))
    x = x.withColumn("b", F.lead("a").over(W.partitionBy("entity").orderBy("ts", "unit"))).withColumn("t", A.duration_days(F.col("a"), F.col("b"), F.lit(EVENTS_AS_OF).cast("date")))
    return x.groupBy("entity").agg(r4(F.avg("t"), "mean_days"), F.max("t").alias("max_days"), F.count("*").alias("n"))


@query(E + f"SELECT entity, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '{EVENTS_AS_OF}') AS INT) AS days FROM e WHERE event_type IN ('error', 'purchase') GROUP BY 1")
def days_since_last(spark, d):
    g = events(spark, d).groupBy("entity").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("a"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("b"))
    latest = F.greatest("a", "b")
    return g.where(latest.isNotNull()).select("entity", F.datediff(F.lit(EVENTS_AS_OF).cast("date"), F.to_date(latest)).alias("days"))


@query(U + "SELECT cohort, rup(quantile_cont(m1 - a, 0.1), 4) q10, rup(quantile_cont(m1 - a, 0.9), 4) q90 FROM (SELECT cohort, m1, avg(m1) OVER (PARTITION BY cohort) a FROM u) GROUP BY 1")
def residual_quantiles(spark, d):
    u = units(spark, d)
    j = u.join(u.groupBy("cohort").agg(F.avg("m1").alias("a")), "cohort").groupBy("cohort").agg(F.percentile(F.col("m1") - F.col("a"), F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return j.select("cohort", r4(F.col("q")[0], "q10"), r4(F.col("q")[1], "q90"))


@query(U + "SELECT segment, label, count(*) n FROM u GROUP BY 1, 2")
def value_counts(spark, d):
    counts = units(spark, d).groupBy("segment", "label").agg(F.count("*").alias("n")).groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    return counts.select("segment", F.explode("m").alias("label", "n"))


@query(U + "SELECT l AS label, count(unit) n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) t(l) LEFT JOIN u ON label = l GROUP BY 1")
def bucket_counts(spark, d):
    return A.bucket_counts(units(spark, d).withColumnRenamed("label", "b"), "b", ["1-URGENT", "2-HIGH", "9-NONE"]).select("label", "n")


@query(U + "SELECT entity, unit, m1 FROM (SELECT entity, unit, CASE WHEN unit % 3 <> 0 THEN m1 END m1, CASE WHEN unit % 2 = 0 THEN m2 END m2, row_number() OVER (PARTITION BY entity ORDER BY CAST(unit % 3 <> 0 AS INT) + CAST(unit % 2 = 0 AS INT) DESC, exposure DESC, unit) k FROM u) WHERE k = 1")
def prefer_fuller_row(spark, d):
    u = units(spark, d).withColumns({"m1": F.when(F.col("unit") % 3 != 0, F.col("m1")), "m2": F.when(F.col("unit") % 2 == 0, F.col("m2"))})
    return A.prefer_fuller(u, ["entity"], ["m1", "m2"], [F.desc("exposure"), "unit"]).select("entity", "unit", "m1")


# windows

ROLL = """, r AS (SELECT unit, entity, ts, unnest(['m1', 'm2', 'm3']) metric, unnest([m1, m2, m3]) v FROM u WHERE exposure >= 45),
k AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY ts DESC, unit DESC) n FROM r WHERE v IS NOT NULL) """


@query(U + ROLL + """SELECT entity, metric, rup(avg(v) FILTER (n <= 3), 4) roll_3, rup(avg(v) FILTER (n <= 5), 4) roll_5, rup(avg(v) FILTER (n <= 10), 4) roll_10, rup(avg(v), 4) period_avg,
rup(stddev_pop(v) FILTER (n <= 10), 4) roll_10_std, rup(CASE WHEN avg(v) FILTER (n <= 10) <> 0 THEN stddev_pop(v) FILTER (n <= 10) / avg(v) FILTER (n <= 10) END, 4) roll_10_cv FROM k GROUP BY 1, 2""")
def rolling_form(spark, d):
    long = N.to_long(units(spark, d).where("exposure >= 45"), ["entity", "unit", "ts"], ["m1", "m2", "m3"])
    out = N.rolling_form(long, ["entity", "metric"], [F.desc("ts"), F.desc("unit")])
    return out.select("entity", "metric", *(r4(F.col(c), c) for c in ("roll_3", "roll_5", "roll_10", "period_avg", "roll_10_std", "roll_10_cv")))


@query(U + ROLL + "SELECT entity, metric, CASE WHEN count(*) >= 2 THEN rup(regr_slope(v, -n) FILTER (n <= 10), 3) END slope_10, CASE WHEN count(*) >= 2 THEN rup(regr_slope(v, -n), 3) END slope_all FROM k GROUP BY 1, 2")
def trend_slope(spark, d):
    long = N.to_long(units(spark, d).where("exposure >= 45"), ["entity", "unit", "ts"], ["m1", "m2", "m3"])
    out = N.rolling_form(long, ["entity", "metric"], [F.desc("ts"), F.desc("unit")])
    return out.select("entity", "metric", round_up("trend_slope_10", 3).alias("slope_10"), round_up("trend_slope_all", 3).alias("slope_all"))


PEER = ", g AS (SELECT entity, cohort, segment, period, round(avg(m1 / exposure * 90), 6) x FROM u WHERE exposure >= 1 GROUP BY 1, 2, 3, 4) "


def peer_frame(spark, d):
    """Mean rates, equal for equal units: by a sum in order of rows some copies of an entity would round up and others down."""
    rates = A.per_exposure(units(spark, d), ["m1"])
    return rates.groupBy("entity", "cohort", "segment", "period").agg(F.round(A.exact_mean(F.col("m1_rate")), 6).alias("x"))


@query(U + PEER + """SELECT entity, period, rup(100 * cume_dist() OVER (PARTITION BY cohort, segment, period ORDER BY x), 4) AS percentile,
 rup(x / avg(x) OVER (PARTITION BY cohort, segment, period) * coalesce(avg(CASE WHEN cohort = 0 THEN x END) OVER (PARTITION BY segment, period), avg(x) OVER (PARTITION BY cohort, segment, period)), 3) AS adjusted FROM g""")
def peer_percentile(spark, d):
    from cohortrank.plans.features import peer_percentile as plan

    return plan(peer_frame(spark, d), "x", 0).select("entity", "period", r4(F.col("percentile"), "percentile"), round_up("adjusted", 3).alias("adjusted"))


@query(U + PEER + ", p AS (SELECT entity, segment, period, x + 1 AS y FROM g WHERE cohort = 3) SELECT p.entity, p.period, rup(100.0 * count(g.entity) FILTER (g.x <= p.y) / count(g.entity), 4) AS percentile FROM p JOIN g ON g.cohort = 5 AND g.segment = p.segment AND g.period = p.period GROUP BY 1, 2")
def probe_percentile(spark, d):
    g = peer_frame(spark, d)
    probes = g.where("cohort = 3").select("entity", "segment", "period", (F.col("x") + 1).alias("x"))
    out = N.probe_percentile(probes, g.where("cohort = 5").select("segment", "period", "x"), ["segment", "period"], "x")
    return out.where("percentile IS NOT NULL").select("entity", "period", r4(F.col("percentile"), "percentile"))


@query(U + PEER + ", k AS (SELECT *, rank() OVER w - 1 b, count(*) OVER (PARTITION BY cohort, segment, period, x) t, count(*) OVER (PARTITION BY cohort, segment, period) n FROM g WINDOW w AS (PARTITION BY cohort, segment, period ORDER BY x)) SELECT entity, period, CASE WHEN n >= 3 THEN rup(100 * (2 * b + t) / (2.0 * n), 4) END AS percentile FROM k")
def midrank_percentile(spark, d):
    return N.midrank_percentile(peer_frame(spark, d), ["cohort", "segment", "period"], "x").select("entity", "period", r4(F.col("percentile"), "percentile"))


@query(U + ", k AS (SELECT unit, rank() OVER (PARTITION BY cohort, period ORDER BY m2) r, count(*) OVER (PARTITION BY cohort, period, m2) t, count(*) OVER (PARTITION BY cohort, period) n FROM u) SELECT unit, rup(100 * (r + (t - 1) / 2.0) / n, 4) AS rank_pct FROM k")
def avg_rank_pct(spark, d):
    return N.average_rank_pct(units(spark, d), ["cohort", "period"], "m2").select("unit", r4(F.col("rank_pct"), "rank_pct"))


@query(U + "SELECT unit, max(m1) OVER (PARTITION BY entity, period) AS top FROM u")
def group_max_over(spark, d):
    return units(spark, d).select("unit", F.max("m1").over(W.partitionBy("entity", "period")).alias("top"))


STREAK = ", k AS (SELECT entity, value, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, unit DESC) n FROM e) SELECT entity, coalesce(min(CASE WHEN NOT coalesce(value >= 60, false) THEN n END) - 1, count(*)) AS streak FROM k GROUP BY 1"


@query(E + STREAK)
def trailing_streak(spark, d):
    return N.trailing_streak(events(spark, d), ["entity"], [F.desc("ts"), F.desc("unit")], F.col("value") >= 60)


BINS = ", k AS (SELECT *, row_number() OVER (PARTITION BY brief ORDER BY score, entity) r, count(*) OVER (PARTITION BY brief) n FROM o), b AS (SELECT *, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((r - 1) * least(10, n) / (n - 1))) END AS INT) bin FROM k) "


@query(O + BINS + "SELECT entity, bin FROM b")
def decile_bins(spark, d):
    return N.equal_count_bins(outcomes(spark, d), ["score", "entity"], 10, ["brief"]).select("entity", "bin")


@query(U + "SELECT cohort, entity, total, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY total DESC, entity) place FROM (SELECT cohort, entity, round(sum(m1), 2) total FROM u GROUP BY 1, 2)) WHERE place <= 5")
def topn_per_group(spark, d):
    g = units(spark, d).groupBy("cohort", "entity").agg(F.round(F.sum("m1"), 2).alias("total"))
    return N.top_per_group(g, ["cohort"], [F.desc("total"), "entity"], 5)


@query(U + ", g AS (SELECT entity, CAST(period AS INT) y, sum(m1) s, sum(exposure) x FROM u GROUP BY 1, 2) SELECT entity, y, rup(sum(s) OVER w / sum(x) OVER w * 90, 4) AS rate FROM g WINDOW w AS (PARTITION BY entity ORDER BY y RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)")
def lookback_rate(spark, d):
    g = units(spark, d).groupBy("entity", F.col("period").cast("int").alias("y")).agg(F.sum("m1").alias("s"), F.sum("exposure").alias("x"))
    over = W.partitionBy("entity").orderBy("y").rangeBetween(-2, 0)
    return g.select("entity", "y", r4(F.sum("s").over(over) / F.sum("x").over(over) * 90, "rate"))


@query(U + "SELECT entity, period FROM (SELECT entity, period, row_number() OVER (PARTITION BY entity ORDER BY min(ts) DESC) k FROM u GROUP BY 1, 2) WHERE k <= 3")
def recent_periods(spark, d):
    g = units(spark, d).groupBy("entity", "period").agg(F.min("ts").alias("t"))
    return N.top_per_group(g, ["entity"], [F.desc("t")], 3).select("entity", "period")


# tops and sets

@query(U + "SELECT entity, round(sum(m1), 2) total FROM u GROUP BY 1 ORDER BY total DESC, entity LIMIT 60")
def topk_global(spark, d):
    return units(spark, d).groupBy("entity").agg(F.round(F.sum("m1"), 2).alias("total")).orderBy(F.desc("total"), "entity").limit(60)


@query("SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END bal FROM customer) ORDER BY bal DESC NULLS LAST, c_custkey LIMIT 40")
def topk_nulls_last(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    return c.orderBy(F.desc_nulls_last("bal"), "c_custkey").limit(40)


@query("SELECT p_partkey, p_size FROM part ORDER BY coalesce(nullif(p_size, 7), 99) DESC, p_retailprice, p_partkey LIMIT 30")
def multi_key_sort(spark, d):
    return table(spark, d, "part").orderBy(F.coalesce(F.nullif("p_size", F.lit(7)), F.lit(99)).desc(), "p_retailprice", "p_partkey").limit(30).select("p_partkey", "p_size")


@query(U + "SELECT entity, unit FROM (SELECT entity, unit, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, unit DESC) k FROM u) WHERE k <= 25")
def recent_n(spark, d):
    return N.top_per_group(units(spark, d), ["entity"], [F.desc("ts"), F.desc("unit")], 25).select("entity", "unit")


@query("SELECT k, sum(n) n FROM (SELECT l_partkey k, count(*) n FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, count(*) FROM lineitem GROUP BY 1) GROUP BY 1")
def union_all_sum(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def union_distinct(spark, d):
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"))
    return a.union(table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def set_intersect(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(table(spark, d, "part").where("p_size < 10").select("p_partkey"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY 1, 2")
def distinct_pairs(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct().orderBy("c_nationkey", "c_mktsegment")
