"""Feature, scoring, gate and workflow plans on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.operators import aggregates as A
from cohortrank.operators import joins as J
from cohortrank.operators import similar as SI
from cohortrank.operators import windows as N
from cohortrank.plans import features as P
from cohortrank.plans import gates as G
from cohortrank.plans import scoring as C
from cohortrank.plans import workflow as V
from cohortrank.queries.adapters import AS_OF, EVENTS_AS_OF, EVENTS_SQL, OUTCOMES_SQL, SNAPSHOTS_SQL, SUPPLY_SQL, UNITS_SQL, events, outcomes, snapshots, supply, table, units
from cohortrank.queries.relational import TIERS, r4
from cohortrank.queries.shapes import BINS, PEER, peer_frame
from cohortrank.registry import query, round_up
from cohortrank.storage import written_once

U, E, SU, SN, O = (f"WITH {x} " for x in (UNITS_SQL, EVENTS_SQL, SUPPLY_SQL, SNAPSHOTS_SQL, OUTCOMES_SQL))

# features

@query(SN + """, z AS (SELECT region, day, count(*) size FROM n GROUP BY 1, 2), t AS (SELECT entity, m1, least(4, ceil(n.position / greatest(1, CASE WHEN size < 4 THEN 20 ELSE size END // 4))) tier
 FROM u ASOF LEFT JOIN (SELECT n.*, size FROM n JOIN z USING (region, day)) n ON n.cohort = u.cohort AND CAST(u.ts AS DATE) >= n.day)
SELECT entity, rup(avg(m1) FILTER (tier = 1), 4) tier1, rup(avg(m1) FILTER (tier = 2), 4) tier2, rup(avg(m1) FILTER (tier = 3), 4) tier3, rup(avg(m1) FILTER (tier = 4), 4) tier4 FROM t GROUP BY 1""")
def tier_splits(spark, d):
    out = P.tier_splits(units(spark, d).select("entity", "unit", "cohort", "ts", "m1"), snapshots(spark, d), "m1")
    return out.select("entity", *(r4(F.col(f"tier{k}"), f"tier{k}") for k in range(1, 5)))


AVAILABILITY = f""", x AS (SELECT entity, CAST(ts AS DATE) a, lead(CAST(ts AS DATE)) OVER (PARTITION BY entity ORDER BY ts, unit) b FROM e WHERE event_type = 'error'),
sp AS (SELECT entity, avg(t) mean_gap, max(t) max_gap FROM (SELECT entity, greatest(date_diff('day', a, coalesce(b, DATE '{EVENTS_AS_OF}')), 0) t FROM x) GROUP BY 1),
rs AS (SELECT entity, sum(greatest(c - 1, 0)) / sum(c) repeat_share FROM (SELECT entity, event_type, count(*) c FROM e GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT entity, value, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, unit DESC) n FROM e),
st AS (SELECT entity, coalesce(min(CASE WHEN NOT coalesce(value >= 60, false) THEN n END) - 1, count(*)) streak FROM k GROUP BY 1),
ba AS (SELECT entity, count(*) FILTER (event_type = 'view') units, count(*) FILTER (event_type = 'purchase') starts, count(*) FILTER (event_type = 'error') episodes,
 date_diff('day', max(CAST(ts AS DATE)) FILTER (event_type = 'error'), DATE '{EVENTS_AS_OF}') days_since FROM e GROUP BY 1),
av AS (SELECT ba.*, mean_gap, coalesce(max_gap, 0) max_gap, repeat_share, streak, CASE WHEN units > 0 THEN least(1.0, starts / units) END AS rate FROM ba LEFT JOIN sp USING (entity) LEFT JOIN rs USING (entity) LEFT JOIN st USING (entity)) """


def available(spark, d):
    return P.availability(events(spark, d), F.lit(EVENTS_AS_OF).cast("date"), "purchase", "error", "view", 60.0)


@query(E + AVAILABILITY + "SELECT entity, units, starts, episodes, CAST(days_since AS INT) days_since, rup(mean_gap, 4) mean_gap, CAST(max_gap AS INT) max_gap, rup(repeat_share, 4) repeat_share, streak, rup(rate, 4) rate FROM av")
def availability_features(spark, d):
    a = available(spark, d)
    return a.select("entity", "units", "starts", "episodes", "days_since", r4(F.col("mean_gap"), "mean_gap"), "max_gap", r4(F.col("repeat_share"), "repeat_share"), "streak", r4(F.col("rate"), "rate"))


@query(U + f""", y AS (SELECT entity, period, avg(m1) a, max(label) label FROM u GROUP BY 1, 2), q AS (SELECT *, first_value(label) OVER (PARTITION BY entity ORDER BY period DESC) la, row_number() OVER (PARTITION BY entity ORDER BY period DESC) n FROM y),
t AS (SELECT entity, coalesce(min(CASE WHEN label <> la THEN n END) - 1, count(*)) stay, count(*) c, regr_slope(a, CAST(period AS DOUBLE)) slope FROM q GROUP BY 1)
SELECT entity, c AS periods, labels, age, rup(CASE WHEN c >= 2 THEN slope END, 3) AS slope, stay AS periods_at_label FROM t JOIN (SELECT entity, count(DISTINCT label) labels, round(date_diff('day', CAST(min(ts) AS DATE), DATE '{AS_OF}') / 365.25, 2) age FROM u GROUP BY 1) USING (entity)""")
def trajectory_features(spark, d):
    return P.trajectory(units(spark, d), F.lit(AS_OF).cast("date")).withColumn("slope", round_up("slope", 3))


@query(U + """, r AS (SELECT entity, unit, ts, unnest(['m1', 'm3']) metric, unnest([m1, m3]) v FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY ts DESC, unit DESC) n FROM r)
SELECT entity, metric, rup(avg(v) FILTER (n <= 5), 4) recent, rup(avg(v), 4) overall, rup(max(v), 4) top, rup(avg(v) FILTER (n <= 5) / nullif(avg(v), 0), 4) ratio FROM k GROUP BY 1, 2""")
def recent_vs_all(spark, d):
    return P.recent_vs_all(units(spark, d), ["m1", "m3"]).select("entity", "metric", *(r4(F.col(c), c) for c in ("recent", "overall", "top", "ratio")))


@query(SU + """, g AS (SELECT entity, segment, round(avg(m1 / exposure), 6) x FROM s GROUP BY 1, 2), k AS (SELECT entity, rank() OVER (PARTITION BY segment ORDER BY x) r, count(*) OVER (PARTITION BY segment, x) t, count(*) OVER (PARTITION BY segment) n FROM g)
SELECT entity, rup(avg(100 * (r + (t - 1) / 2.0) / n), 4) AS rank_pct FROM k GROUP BY 1""")
def rank_matrix(spark, d):
    g = supply(spark, d).groupBy("entity", "segment").agg(F.round(F.avg(F.col("m1") / F.col("exposure")), 6).alias("x"))
    return N.average_rank_pct(g, ["segment"], "x").groupBy("entity").agg(r4(F.avg("rank_pct"), "rank_pct"))


@query(SU + """, c AS (SELECT entity, unit, line AS "row", 1 + CAST(exposure AS INT) % 5 AS col FROM s WHERE line <= 3), w AS (SELECT *, max(col) OVER (PARTITION BY entity, unit, "row") width FROM c)
SELECT entity, count(*) cells, rup(avg(CAST("row" <= 2 AND width >= 3 AND NOT (col = 1 OR col = width) AS INT)), 4) central_share, rup(avg(CAST(col = 1 OR col = width AS INT)), 4) wide_share FROM w GROUP BY 1""")
def grid_share(spark, d):
    cells = supply(spark, d).select("entity", "unit", F.col("line").alias("row"), (1 + F.col("exposure").cast("int") % 5).alias("col"))
    return P.grid_share(cells, ["entity"]).select("entity", "cells", r4(F.col("central_share"), "central_share"), r4(F.col("wide_share"), "wide_share"))


@query(U + ", g AS (SELECT entity, period, avg(CAST(label IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS INT)) share FROM u GROUP BY 1, 2), t AS (SELECT *, lead(share) OVER (PARTITION BY entity ORDER BY period) ns FROM g) SELECT entity, period, rup(share, 4) share, CAST(ns >= 0.75 AS INT) AS target FROM t WHERE ns IS NOT NULL")
def forward_target(spark, d):
    return P.forward_target(units(spark, d), F.col("label").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select("entity", "period", r4(F.col("share"), "share"), "target")


# scoring

LONG = """, lg AS (SELECT entity, cohort, segment, period, metric, round(avg(v), 6) x FROM (SELECT entity, cohort, segment, period, unnest(['m1', 'm2', 'm3']) metric, unnest([m1 / exposure * 90, m2 / exposure * 90, m3 / exposure * 90]) v FROM u WHERE exposure >= 1) GROUP BY ALL),
pc AS (SELECT entity, period, metric, 100 * cume_dist() OVER (PARTITION BY cohort, segment, period, metric ORDER BY x) p FROM lg) """
#: Template of the demonstration queries: metric and weight.
TEMPLATE = [("m1", 0.5), ("m2", 0.3), ("m3", 0.2)]


def held_units(spark, d):
    """The units, computed once for all parts of a plan."""
    return written_once(units(spark, d), "units")


def percentiles(u):
    rates = A.per_exposure(u, ["m1", "m2", "m3"])
    long = N.to_long(rates.select("entity", "unit", "cohort", "segment", "period", *(F.col(f"{m}_rate").alias(m) for m in ("m1", "m2", "m3"))), ["entity", "unit", "cohort", "segment", "period"], ["m1", "m2", "m3"])
    mean = long.groupBy("entity", "cohort", "segment", "period", "metric").agg(F.round(F.avg("value"), 6).alias("x"))
    return N.member_percentile(mean, ["cohort", "segment", "period", "metric"], "x").select("entity", "cohort", "segment", "period", "metric", "x", "percentile")


def template(spark):
    return spark.createDataFrame(TEMPLATE, "metric string, weight double")


@query(U + LONG + ", c AS (SELECT entity, period, count(*) / (count(*) + 10.0) f FROM u WHERE exposure > 0 GROUP BY 1, 2) SELECT entity, period, rup(least(greatest(sum(p * CASE metric WHEN 'm1' THEN 0.5 WHEN 'm2' THEN 0.3 ELSE 0.2 END) * f + 50 * (1 - f), 0), 100), 4) AS fit FROM pc JOIN c USING (entity, period) GROUP BY entity, period, f")
def template_fit(spark, d):
    u = held_units(spark, d)
    p = percentiles(u).join(P.confidence(u).select("entity", "period", "shrinkage"), ["entity", "period"])
    return C.template_fit(p, template(spark), ["entity", "period"], "shrinkage").select("entity", "period", r4(F.col("fit"), "fit"))


@query(U + LONG + "SELECT entity, period, rup(least(greatest(CASE WHEN sum(w) > 0 AND sum(w) < 1 THEN sum(w * p) / sum(w) ELSE sum(w * p) END, 0), 100), 4) AS fit FROM pc JOIN (VALUES ('m1', 0.4), ('m3', 0.4)) t(metric, w) USING (metric) GROUP BY 1, 2")
def profile_fit(spark, d):
    weights = spark.createDataFrame([("m1", 0.4), ("m3", 0.4)], "metric string, weight double")
    return C.profile_fit(percentiles(units(spark, d)), weights, ["entity", "period"]).select("entity", "period", r4(F.col("fit"), "fit"))


CURRENT = LONG + """, mp AS (SELECT entity, avg(p) a FROM pc GROUP BY 1),
rk AS (SELECT entity, m1, label, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, unit DESC) n FROM u),
fm AS (SELECT entity, avg(m1) FILTER (n <= 10) a10, stddev_pop(m1) FILTER (n <= 10) s10, avg(m1) base, avg(m1) FILTER (label = '1-URGENT') top, count(*) c, regr_slope(m1 / 100000, -n) FILTER (n <= 10) sl FROM rk GROUP BY 1),
cur AS (SELECT entity, rup(0.5 * a + 0.2 * coalesce(least(greatest(100 / (1 + s10 / a10), 0), 100), 50) + 0.15 * CASE WHEN c >= 2 THEN least(greatest(50 + 50 * sl, 0), 100) ELSE 50 END
 + 0.15 * CASE WHEN top IS NULL THEN 50 ELSE least(greatest(50 * top / base, 0), 100) END, 9) AS score FROM mp JOIN fm USING (entity)) """


def current_frame(u):
    level = percentiles(u).groupBy("entity").agg(F.avg("percentile").alias("level"))
    scaled = u.select("entity", "ts", "unit", (F.col("m1") / 100000).alias("m"))
    form = N.rolling_form(N.to_long(scaled, ["entity", "ts", "unit"], ["m"]), ["entity"], [F.desc("ts"), F.desc("unit")]).select("entity", "roll_10_cv", "trend_slope_10")
    tops = u.groupBy("entity").agg(F.avg("m1").alias("base"), F.avg(F.when(F.col("label") == "1-URGENT", F.col("m1"))).alias("top"))
    j = level.join(form, "entity").join(tops, "entity")
    return j.select("entity", C.current_performance(F.col("level"), F.col("roll_10_cv"), F.col("trend_slope_10"), F.col("top"), F.col("base")).alias("score"))


@query(U + CURRENT + "SELECT entity, rup(score, 3) AS score FROM cur")
def current_performance(spark, d):
    return current_frame(held_units(spark, d)).select("entity", round_up("score", 3).alias("score"))


WEIGHTS = C.layer_weights("emerging_asset", "championship_transition")
FITS = """, f AS (SELECT entity, rup(least(greatest(avg(z), 0), 100), 9) fit FROM (SELECT entity, period, sum(p * CASE metric WHEN 'm1' THEN 0.5 WHEN 'm2' THEN 0.3 ELSE 0.2 END) z FROM pc GROUP BY 1, 2) GROUP BY 1) """
COMPOSITE = U + CURRENT + FITS + f""", b AS (SELECT entity, cohort, sum(exposure) x, avg(m1) / 20000 pr, avg(CAST(status = 'F' AS INT)) share, count(*) c, greatest(0.35, sqrt(least(1, sum(exposure) / 900))) ev FROM u GROUP BY 1, 2),
pj AS (SELECT *, rup(CASE WHEN pr <= 0 THEN 0 WHEN pr <= 2.7 THEN 30 * pr / 2.7 WHEN pr <= 3.88 THEN 30 + 20 * (pr - 2.7) / (3.88 - 2.7) WHEN pr <= 6.29 THEN 50 + 30 * (pr - 3.88) / (6.29 - 3.88) ELSE 80 + 20 * (1 - exp(-(pr - 6.29) / 3.0)) END, 9) proj,
 rup(least(greatest(50 + 50 * (share - 0.5), 0), 100), 9) fin, rup(least(0.95, 0.5 + share / 2), 9) av FROM b),
cs AS (SELECT entity, cohort, c, fit, score, proj, fin, ev, av, rup((CASE WHEN fit < 40 THEN least(raw, 60) ELSE raw END) * ev * av, 9) AS composite FROM (
 SELECT pj.*, fit, score, fit * {WEIGHTS['role_fit']!r} + (CASE WHEN proj >= 70 THEN greatest(30, score) ELSE score END) * {WEIGHTS['current']!r} + proj * {WEIGHTS['projection']!r} + fin * {WEIGHTS['financial']!r} AS raw FROM pj JOIN f USING (entity) JOIN cur USING (entity))) """


def composite_frame(u):
    """Per entity the parts of the composite and the composite itself."""
    p = percentiles(u)
    fit = C.template_fit(p, template(u.sparkSession), ["entity", "period"]).groupBy("entity").agg(S.clamp(F.avg("raw")).alias("fit"))
    b = u.groupBy("entity", "cohort").agg(F.sum("exposure").alias("x"), (F.avg("m1") / 20000).alias("rate"), F.avg((F.col("status") == "F").cast("int")).alias("share"), F.count("*").alias("n"))
    j = b.join(fit, "entity").join(current_frame(u), "entity")
    j = j.withColumns({"projection": S.calibrated(F.col("rate"), 2.7, 3.88, 6.29), "financial": C.financial_score(F.col("share") - 0.5), "evidence": S.evidence_multiplier(F.col("x")), "available": F.least(F.lit(0.95), 0.5 + F.col("share") / 2)})
    j = j.withColumns({c: S.settled(F.col(c)) for c in ("fit", "score", "projection", "financial", "available")})
    columns = C.Composite(WEIGHTS, True).columns(*(F.col(c) for c in ("fit", "score", "projection", "financial", "evidence", "available")))
    return j.withColumns(columns)


@query(COMPOSITE + "SELECT entity, rup(composite, 3) AS composite, fit < 40 AS capped FROM cs")
def composite_score(spark, d):
    return composite_frame(held_units(spark, d)).select("entity", round_up("composite", 3).alias("composite"), "capped")


@query(COMPOSITE + "SELECT a.entity, CASE WHEN b.m = 0 THEN 100.0 ELSE round(100 * (a.m - b.m) / b.m, 2) END AS gap_pct FROM (SELECT entity, (fit + proj) / 2 m FROM cs) a JOIN (SELECT entity, (fit + proj) / 2 m FROM cs) b ON b.entity = a.entity // 10 * 10")
def gap_vs_reference(spark, d):
    m = composite_frame(held_units(spark, d)).select("entity", ((F.col("fit") + F.col("projection")) / 2).alias("m"))
    other = m.select(F.col("entity").alias("other"), F.col("m").alias("r"))
    j = m.join(other, (F.floor(F.col("entity") / 10) * 10) == F.col("other"))
    return j.select("entity", F.when(F.col("r") == 0, 100.0).otherwise(F.round(100 * (F.col("m") - F.col("r")) / F.col("r"), 2)).alias("gap_pct"))


BOARD = COMPOSITE + """, bd AS (SELECT entity, cohort, rup((0.40 * fit + 0.35 * score + 0.25 * proj) * (0.55 + 0.45 * ev), 3) overall, rup((0.55 * fit + 0.45 * score) * (0.55 + 0.45 * ev), 3) present FROM cs) """


@query(BOARD + "SELECT cohort, board, entity, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cohort, board ORDER BY score DESC, entity) place FROM (SELECT cohort, entity, 'overall' board, overall score FROM bd UNION ALL SELECT cohort, entity, 'present', present FROM bd)) WHERE place <= 5")
def board_rankings(spark, d):
    soft = S.soft_multiplier(F.col("evidence"))
    b = composite_frame(held_units(spark, d)).select(
        "entity", "cohort", round_up((0.40 * F.col("fit") + 0.35 * F.col("score") + 0.25 * F.col("projection")) * soft, 3).alias("overall"), round_up((0.55 * F.col("fit") + 0.45 * F.col("score")) * soft, 3).alias("present")
    )
    long = b.unpivot(["cohort", "entity"], ["overall", "present"], "board", "score")
    return N.top_per_group(long, ["cohort", "board"], [F.desc("score"), "entity"], 5).select("cohort", "board", "entity", "score", "place")


@query(COMPOSITE + "SELECT entity, rup(least(greatest(100 * (1 - exp(-greatest(composite, 0) / 19.0)), 0), 100), 3) AS board, CASE WHEN composite >= 40 THEN 'Tier 1' WHEN composite >= 34 THEN 'Tier 2' WHEN composite >= 28 THEN 'Tier 3' WHEN composite >= 22 THEN 'Tier 4' ELSE 'Tier 5' END AS tier, CAST(fit >= 60 AS INT) + CAST(score >= 60 AS INT) + CAST(proj >= 60 AS INT) AS strengths FROM cs")
def decorate_predictions(spark, d):
    c = composite_frame(held_units(spark, d))
    strengths = F.array_compact(F.array(*(F.when(F.col(x) >= 60, F.lit(x)) for x in ("fit", "score", "projection"))))
    return c.select("entity", round_up(S.board_score(F.col("composite")), 3).alias("board"), S.tier_of(F.col("composite"), TIERS).alias("tier"), F.size(strengths).alias("strengths"))


@query(U + "SELECT DISTINCT a.segment, b.segment AS sibling FROM (SELECT DISTINCT segment, length(segment) % 2 family FROM u) a JOIN (SELECT DISTINCT segment, length(segment) % 2 family FROM u) b USING (family) WHERE a.segment <> b.segment")
def family_siblings(spark, d):
    s = units(spark, d).select("segment").distinct().withColumn("family", F.length("segment") % 2)
    return s.join(s.withColumnRenamed("segment", "sibling"), "family").where("segment <> sibling").select("segment", "sibling")


@query(COMPOSITE + "SELECT entity, rup(fit, 3) fit, rup(score, 3) score, rup(proj, 3) projection, rup(composite, 3) composite FROM cs WHERE entity IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def comparison_table(spark, d):
    chosen = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("entity")).distinct()
    c = composite_frame(held_units(spark, d)).join(chosen, "entity", "left_semi")
    return c.select("entity", *(round_up(x, 3).alias(x) for x in ("fit", "score", "projection", "composite")))


@query(COMPOSITE + "SELECT entity, rup(fit, 3) fit, rup(score, 3) score, rup(proj, 3) projection, rup(composite, 3) composite FROM cs")
def comparison_all(spark, d):
    """The columns of the comparison for every entity."""
    return composite_frame(held_units(spark, d)).select("entity", *(round_up(x, 3).alias(x) for x in ("fit", "score", "projection", "composite")))


@query(U + ", g AS (SELECT entity, avg(m1) / 20000 * CASE cohort % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.7 END m, avg(CAST(status = 'F' AS INT)) sr, avg(exposure) x FROM u GROUP BY entity, cohort) SELECT entity, rup(greatest(0, m - greatest(0.05, 0.25 * m)), 4) p10, rup(m, 4) p50, rup(m + greatest(0.05, 0.25 * m), 4) p90, rup(least(greatest(0.45 * sr + 0.55 * least(x / 90, 1), 0.2), 0.92), 4) starter FROM g")
def heuristic_projection(spark, d):
    k = F.col("cohort") % 3
    g = units(spark, d).groupBy("entity", "cohort").agg((F.avg("m1") / 20000).alias("rate"), F.avg((F.col("status") == "F").cast("int")).alias("sr"), F.avg("exposure").alias("x"))
    band = C.heuristic_projection(F.col("rate"), F.when(k == 0, 1.0).when(k == 1, 0.85).otherwise(0.7))
    return g.select("entity", *(r4(x, n) for n, x in band.items()), r4(C.starter_probability(F.col("sr"), F.col("x")), "starter"))


@query("""WITH g AS (SELECT p_partkey, p_retailprice v, CAST(p_size AS DOUBLE) age, p_partkey % 3 - 1 t, p_retailprice * (1 + p_partkey % 5 / 10.0) cost FROM part), r AS (SELECT *, v * (CASE WHEN age < 23 THEN 1.25 WHEN age < 27 THEN 1.1 WHEN age < 30 THEN 0.9 ELSE 0.6 END) * (CASE WHEN t > 0 THEN 1.1 WHEN t < 0 THEN 0.9 ELSE 1.0 END) resale FROM g)
SELECT p_partkey, rup(0.85 * v, 3) low, rup(1.15 * v, 3) high, rup(resale, 3) resale, rup(least(greatest(0.7 * ((0.6 * v + 0.4 * resale) / nullif(cost, 0) - 1) + 0.3 * (age - 50) / 50, -1), 1), 4) value_ratio FROM r""")
def value_bands(spark, d):
    k = F.col("p_partkey")
    age, v = F.col("p_size").cast("double"), F.col("p_retailprice")
    bands = C.value_bands(v, age, k % 3 - 1, age, v * (1 + k % 5 / 10.0))
    return table(spark, d, "part").select("p_partkey", *(round_up(bands[c], 3).alias(c) for c in ("low", "high", "resale")), r4(bands["value_ratio"], "value_ratio"))


@query(E + AVAILABILITY + """, h AS (SELECT entity, least(greatest(0.52 + 0.38 * coalesce(rate, 0.5) - 0.035 * episodes - 0.14 * coalesce(repeat_share, 0) - 0.0015 * max_gap + 0.018 * least(streak, 10) + CASE WHEN coalesce(days_since, 0) > 365 THEN 0.05 ELSE 0 END, 0.2), 0.95) a FROM av)
SELECT entity, rup(a, 4) AS available, CASE WHEN rup(1 - a, 9) > 0.4 THEN 'High' WHEN rup(1 - a, 9) > 0.2 THEN 'Medium' ELSE 'Low' END AS tier FROM h""")
def availability_heuristic(spark, d):
    a = available(spark, d)
    p = C.availability_probability(*(F.col(c) for c in ("rate", "episodes", "repeat_share", "max_gap", "streak", "days_since")))
    return a.select("entity", p.alias("p")).select("entity", r4(F.col("p"), "available"), C.risk_tier(F.col("p")).alias("tier"))


@query(SU + ", r AS (SELECT entity, unit, line, m1, segment, cohort FROM s ORDER BY ts DESC, unit DESC, line, entity LIMIT 60), t AS (SELECT DISTINCT s_suppkey a, s_nationkey n FROM supplier), k AS (SELECT a, unit, line, m1, 100 * CAST(segment = 'R' AS INT) + greatest(0, 15 - 10 * abs(n - cohort)) sc, row_number() OVER (PARTITION BY a ORDER BY 100 * CAST(segment = 'R' AS INT) + greatest(0, 15 - 10 * abs(n - cohort)) DESC, unit DESC, line, entity) k FROM t JOIN r ON entity <> a) SELECT a AS entity, unit, line, CAST(sc AS INT) AS score FROM k WHERE k <= 5")
def comparables_topn(spark, d):
    """The 60 latest deals are few by definition, so they are broadcast to all targets."""
    recent = supply(spark, d).orderBy(F.desc("ts"), F.desc("unit"), "line", "entity").limit(60).withColumnsRenamed({"entity": "seller"})
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("n"))
    pairs = targets.join(F.broadcast(recent), F.col("seller") != F.col("entity"))
    score = 100 * (F.col("segment") == "R").cast("int") + F.greatest(F.lit(0), 15 - 10 * F.abs(F.col("n") - F.col("cohort")))
    return N.top_per_group(pairs.withColumn("score", score), ["entity"], [F.desc("score"), F.desc("unit"), "line", "seller"], 5).select("entity", "unit", "line", "score")


@query(SU + "SELECT entity, period, CAST(sum(CAST(exposure AS INT)) AS BIGINT) shots, rup(sum(CAST(exposure AS INT) * 0.1 + CAST(exposure AS INT) * (CAST(exposure AS INT) + 1) / 2 * 0.001), 4) AS chance FROM s GROUP BY 1, 2")
def expand_and_sum(spark, d):
    x = supply(spark, d).select("entity", "period", F.explode(F.sequence(F.lit(1), F.col("exposure").cast("int"))).alias("k"))
    return x.groupBy("entity", "period").agg(F.count("*").alias("shots"), r4(F.sum(0.1 + F.col("k") * 0.001), "chance"))


@query("""WITH v AS (SELECT vec_id, label, embedding e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 25 = 0), p AS (SELECT q.vec_id a, v.vec_id b, round(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])), 6) s FROM q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id)
SELECT a, b, rup(s, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) k FROM p) WHERE k <= 5""")
def cosine_topn(spark, d):
    """Nearest five of each target within its label; targets are the stated ids divisible by 25."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    found = SI.nearest_in_groups(v.where("vec_id % 25 = 0"), v, "vec_id", "embedding", "label", 5)
    return found.select(F.col("target").alias("a"), F.col("candidate").alias("b"), r4(F.col("similarity"), "cosine"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT q.vec_id AS target, v.vec_id AS candidate, round(list_cosine_similarity(q.e, v.e), 6) AS s, q.e[1] - v.e[1] AS x FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT target, k AS rank, candidate, rup(s, 4) AS similarity, rup(x, 4) AS first_delta FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY s DESC, candidate) k FROM p) WHERE k <= 10""")
def similar_rows(spark, d):
    """Nearest ten of each row whose id is divisible by 20 among all rows, whatever their label."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("embedding")[0].cast("double").alias("first"))
    targets = v.where("vec_id % 20 = 0")
    found = SI.with_deltas(SI.nearest_by_cells(targets, v, "vec_id", "embedding", 10), targets, v, "vec_id", ["first"])
    return found.select("target", "rank", "candidate", r4(F.col("similarity"), "similarity"), r4(F.col("first_delta"), "first_delta"))


# gates and workflow

BRIEF = G.Brief("BUILDING", budget_fee=120000.0, budget_wage=9000.0, age_min=1.5, age_max=6.0, wage_band=6000.0, risk_limit=0.40, projection_needed=True, older_age=5.0)
CONTEXT = COMPOSITE + f""", ct AS (SELECT u.entity, u.cohort, min(segment) seg, round(date_diff('day', CAST(min(ts) AS DATE), DATE '{AS_OF}') / 365.25, 2) age, round(avg(m1), 2) v, round(avg(m1), 2) * 0.06 w, count(*) n FROM u GROUP BY 1, 2),
gt AS (SELECT ct.entity, composite, CASE WHEN ct.n < 3 THEN 'fail' ELSE 'pass' END registration, CASE WHEN v + w * 3 <= 120000.0 + 9000.0 * 3 THEN 'pass' ELSE 'fail' END affordability, CASE WHEN seg = 'BUILDING' THEN 'pass' ELSE 'fail' END segment, 'pass' profile, 'pass' pathway,
 CASE WHEN age BETWEEN 1.5 AND 6 THEN 'pass' WHEN age BETWEEN -0.5 AND 8 THEN 'caution' ELSE 'fail' END age_band, CASE WHEN w > 1.2 * 6000 THEN 'caution' ELSE 'pass' END wage_discipline, CASE WHEN age > 5 THEN 'caution' ELSE 'pass' END age_profile,
 CASE WHEN rup(1 - av, 9) <= 0.4 THEN 'pass' ELSE 'caution' END availability, CASE WHEN ct.n < 20 THEN 'caution' ELSE 'pass' END confidence, CASE WHEN proj >= 40 THEN 'pass' ELSE 'exception' END projection, 'pass' pathway_soft FROM ct JOIN cs USING (entity)) """


def gate_context(spark, d):
    held = held_units(spark, d)
    u = held.groupBy("entity").agg(F.min("segment").alias("seg"), S.age_years(F.to_date(F.min("ts")), F.lit(AS_OF).cast("date")).alias("age"), F.round(F.avg("m1"), 2).alias("value"), F.count("*").alias("caps"))
    u = u.withColumns({"wage": F.col("value") * 0.06, "segments": F.array("seg"), "status": F.when(F.col("caps") < 3, "red").otherwise("green"), "confidence_tier": S.sample_tier(F.col("caps"))})
    c = composite_frame(held).select("entity", "composite", "projection", "available", "fit", S.settled(1 - F.col("available")).alias("risk"))
    return u.join(c, "entity")


@query(CONTEXT + "UNPIVOT (SELECT * EXCLUDE (composite) FROM gt) ON COLUMNS(* EXCLUDE (entity)) INTO NAME gate VALUE result")
def gates(spark, d):
    return G.evaluate(gate_context(spark, d), BRIEF).select("entity", F.explode("gates").alias("g")).select("entity", "g.gate", "g.result")


@query(CONTEXT + "SELECT entity, rup(composite, 3) AS composite FROM gt WHERE registration <> 'fail' AND affordability <> 'fail' AND segment <> 'fail' AND age_band <> 'fail' ORDER BY composite DESC, entity LIMIT 60")
def longlist(spark, d):
    return V.longlist(gate_context(spark, d), BRIEF, {"composite": round_up("composite", 3)}).select("entity", "composite")


@query(O + """, k AS (SELECT *, rank() OVER (PARTITION BY brief ORDER BY score) + (count(*) OVER (PARTITION BY brief, score) - 1) / 2.0 r FROM o)
SELECT brief, count(*) FILTER (hit = 1) positives, count(*) FILTER (hit = 0) negatives, CASE WHEN count(*) FILTER (hit = 1) > 0 AND count(*) FILTER (hit = 0) > 0 THEN rup((sum(r) FILTER (hit = 1) - count(*) FILTER (hit = 1) * (count(*) FILTER (hit = 1) + 1) / 2.0) / (count(*) FILTER (hit = 1) * count(*) FILTER (hit = 0)), 4) END AS auc FROM k GROUP BY 1""")
def backtest_auc(spark, d):
    return V.rank_auc(outcomes(spark, d), ["brief"], "score", "hit").select("brief", "positives", "negatives", r4(F.col("auc"), "auc"))


@query(O + "SELECT brief, count(*) n, rup(avg(hit), 4) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY brief ORDER BY score DESC, entity) k FROM o) WHERE k <= 20 GROUP BY 1")
def precision_at_k(spark, d):
    return V.precision_at(outcomes(spark, d), ["brief"], [F.desc("score"), "entity"], "hit").select("brief", "n", r4(F.col("precision"), "precision"))


@query(O + BINS + "SELECT brief, bin, count(*) n, rup(avg(least(1, score / 5000.0)), 4) predicted, rup(avg(hit), 4) actual, rup(abs(avg(least(1, score / 5000.0)) - avg(hit)), 9) > 0.05 AS alert FROM b GROUP BY 1, 2")
def decile_calibration(spark, d):
    o = outcomes(spark, d).withColumn("p", F.least(F.lit(1.0), F.col("score") / 5000.0))
    return V.calibration(o, ["brief"], "p", ["score", "entity"], "hit").select("brief", "bin", "n", r4(F.col("predicted"), "predicted"), r4(F.col("actual"), "actual"), "alert")


@query(O + "SELECT lang, count(*) assessed, rup(avg(hit), 4) hit_rate, rup(avg(hit2), 4) hit2_rate, count(*) FILTER (hit = 1 AND hit2 = 1) both_hit FROM o GROUP BY 1")
def outcome_metrics(spark, d):
    g = outcomes(spark, d).where("hit IS NOT NULL OR hit2 IS NOT NULL").groupBy("lang")
    return g.agg(F.count("*").alias("assessed"), r4(F.avg(F.coalesce("hit", F.lit(0))), "hit_rate"), r4(F.avg(F.coalesce("hit2", F.lit(0))), "hit2_rate"), F.count_if((F.col("hit") == 1) & (F.col("hit2") == 1)).alias("both_hit"))


@query(E + "SELECT event_type, CASE WHEN value >= 50 THEN 'done' ELSE 'pending' END AS outcome, count(*) n FROM e WHERE contains(CAST(ts AS VARCHAR), '2024-01-1') GROUP BY 1, 2")
def window_audit(spark, d):
    e = events(spark, d).where(F.contains(F.col("ts").cast("string"), F.lit("2024-01-1")))
    return e.groupBy("event_type", F.coalesce(F.when(F.col("value") >= 50, "done"), F.lit("pending")).alias("outcome")).agg(F.count("*").alias("n"))


READY = ", g AS (SELECT entity, count(*) FILTER (event_type = 'view') notes, bool_or(event_type = 'purchase') top, bool_or(value >= 90) fit FROM e GROUP BY 1) "


@query(E + READY + "SELECT entity, notes >= 3 AND top AND fit AS ready FROM g")
def readiness_check(spark, d):
    g = events(spark, d).groupBy("entity").agg(F.count_if(F.col("event_type") == "view").alias("notes"), F.bool_or(F.col("event_type") == "purchase").alias("top"), F.bool_or(F.col("value") >= 90).alias("fit"))
    return g.select("entity", ((F.col("notes") >= 3) & F.col("top") & F.col("fit")).alias("ready"))


@query(E + READY + "SELECT entity, concat_ws(';', CASE WHEN NOT notes >= 3 THEN 'notes' END, CASE WHEN NOT top THEN 'top' END, CASE WHEN NOT fit THEN 'fit' END) AS unmet FROM g")
def unmet_conditions(spark, d):
    g = events(spark, d).groupBy("entity").agg(F.count_if(F.col("event_type") == "view").alias("notes"), F.bool_or(F.col("event_type") == "purchase").alias("top"), F.bool_or(F.col("value") >= 90).alias("fit"))
    return g.select("entity", F.array_join(V.unmet({"notes": F.col("notes") >= 3, "top": F.col("top"), "fit": F.col("fit")}), ";").alias("unmet"))


@query(U + "SELECT coalesce(max(CASE WHEN CAST(period AS INT) <= 1998 THEN CAST(period AS INT) END), max(CAST(period AS INT))) AS period FROM u")
def resolve_period(spark, d):
    return V.resolve_period(units(spark, d), 1999)


@query(U + "SELECT entity, count(*) n, round(sum(m1), 2) total, rup(sum(m1) * 90 / sum(exposure), 2) rate, min(ts) first_ts, max(ts) last_ts, count(DISTINCT period) periods FROM u GROUP BY 1")
def entity_profile(spark, d):
    return units(spark, d).groupBy("entity").agg(F.count("*").alias("n"), F.round(F.sum("m1"), 2).alias("total"), round_up(F.sum("m1") * 90 / F.sum("exposure"), 2).alias("rate"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("period").alias("periods"))


@query("""SELECT 'orders_pk' AS rule, count(*) n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lines_pk', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'lines_fk', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'childless', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customer_null', count(*) FROM orders WHERE o_custkey IS NULL""")
def dq_checks(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    parts = [
        count(V.duplicate_keys(o, ["o_orderkey"]), "orders_pk"), count(V.duplicate_keys(li, ["l_orderkey", "l_linenumber"]), "lines_pk"),
        count(V.orphans(li, "l_orderkey", o, "o_orderkey"), "lines_fk"), count(V.orphans(o, "o_orderkey", li, "l_orderkey"), "childless"), count(o.where("o_custkey IS NULL"), "customer_null"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
