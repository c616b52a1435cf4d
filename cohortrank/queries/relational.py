"""Sources, scalar functions, joins, aggregates, windows, tops and sets on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.operators import aggregates as A
from cohortrank.operators import joins as J
from cohortrank.operators import merge as M
from cohortrank.operators import windows as N
from cohortrank.queries.adapters import AS_OF, EVENTS_SQL, SUPPLY_SQL, UNITS_SQL, events, supply, table, units
from cohortrank.storage import written_once
from cohortrank.registry import query, round_up

U = f"WITH {UNITS_SQL} "
E = f"WITH {EVENTS_SQL} "
SU = f"WITH {SUPPLY_SQL} "


def r4(c, name):
    return round_up(c, 4).alias(name)


# sources and sinks

@query(U + "SELECT entity, unit, ts, m1 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, unit DESC) k FROM u) WHERE k = 1")
def latest_entity_row(spark, d):
    return units(spark, d).groupBy("entity").agg(F.max_by(F.struct("unit", "ts", "m1"), F.struct("ts", "unit")).alias("x")).select("entity", "x.unit", "x.ts", "x.m1")


@query("SELECT l_quantity >= 1 AND l_discount BETWEEN 0 AND 0.08 AS good, count(*) n, round(sum(l_extendedprice), 2) total FROM lineitem GROUP BY 1")
def reject_split(spark, d):
    good = (F.col("l_quantity") >= 1) & F.col("l_discount").between(0, 0.08)
    return table(spark, d, "lineitem").groupBy(good.alias("good")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT c_custkey, '20' || regexp_extract(replace(c_name, '#', '') , '([0-9]{2})[0-9]{2}$', 1) AS period FROM customer")
def period_from_name(spark, d):
    name = F.regexp_replace(F.regexp_replace("c_name", "#", ""), r"^.*?(\d{2})(\d{2})$", "$1-$2")
    return table(spark, d, "customer").select("c_custkey", S.period_from_name(name).alias("period"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total, count(*) AS n FROM events GROUP BY 1")
def json_flatten(spark, d):
    return table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint")).groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("*").alias("n"))


@query(U + "SELECT cohort, count(*) FILTER (label = '1-URGENT') urgent, count(*) FILTER (label = '2-HIGH') high, count(*) FILTER (label = '5-LOW') low FROM u GROUP BY 1")
def kv_array_pivot(spark, d):
    pairs = units(spark, d).groupBy("cohort", "label").agg(F.count("*").alias("n")).groupBy("cohort").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    get = lambda k, name: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("long").alias(name)
    return pairs.select("cohort", get("1-URGENT", "urgent"), get("2-HIGH", "high"), get("5-LOW", "low"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'detail' ELSE 'fallback' END AS origin, o_totalprice FROM orders")
def prefer_then_fallback(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    detail = orders.where("o_totalprice >= 200000").select("o_orderkey", F.lit("detail").alias("origin"), "o_totalprice")
    return J.prefer_then_fallback(detail, orders.select("o_orderkey", F.lit("fallback").alias("origin"), "o_totalprice"), "o_orderkey")


@query("""SELECT p_partkey, a.n, round(b.price, 2) price, round(c.qty, 2) qty FROM part
LEFT JOIN (SELECT l_partkey k, count(*) n FROM lineitem GROUP BY 1) a ON a.k = p_partkey
LEFT JOIN (SELECT l_partkey k, max(l_extendedprice) price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.k = p_partkey
LEFT JOIN (SELECT l_partkey k, sum(l_quantity) qty FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) c ON c.k = p_partkey""")
def multi_left_join(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    out = table(spark, d, "part").select("p_partkey")
    out = out.join(li.groupBy("p_partkey").agg(F.count("*").alias("n")), "p_partkey", "left")
    out = out.join(li.where("l_returnflag = 'R'").groupBy("p_partkey").agg(F.round(F.max("l_extendedprice"), 2).alias("price")), "p_partkey", "left")
    return out.join(li.where("l_linestatus = 'O'").groupBy("p_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty")), "p_partkey", "left")


@query(U + """, c AS (SELECT cohort, unnest([entity % 7, entity % 11, entity % 13]) cand, unnest([m1, m2, m3]) score FROM u)
SELECT cohort, cand, rup(max(score), 4) score FROM c WHERE cand NOT IN (0, 1) GROUP BY 1, 2""")
def wide_candidates_to_array(spark, d):
    one = lambda k, m: F.struct((F.col("entity") % k).alias("cand"), F.col(m).alias("score"))
    long = units(spark, d).select("cohort", F.inline(F.array(one(7, "m1"), one(11, "m2"), one(13, "m3"))))
    mapped = spark.range(2).select(F.col("id").alias("cand"))
    return long.groupBy("cohort", "cand").agg(r4(F.max("score"), "score")).join(mapped, "cand", "left_anti").select("cohort", "cand", "score")


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 2.0 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT o_orderkey + 100000000, CAST(NULL AS VARCHAR), 2.0 FROM orders WHERE o_orderkey % 30 = 0""")
def upsert_last_wins(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    keys = base.where("o_orderkey % 3 = 0").select("o_orderkey").unionByName(base.where("o_orderkey % 30 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey")))
    payload = keys.select("o_orderkey", F.lit(1.0).alias("o_totalprice"), F.lit(1).alias("seq")).unionByName(keys.select("o_orderkey", F.lit(2.0).alias("o_totalprice"), F.lit(2).alias("seq")))
    return M.upsert(base, payload, ["o_orderkey"], "seq")


@query(SU + """, y AS (SELECT period, p FROM (SELECT CAST(year(o_orderdate) AS VARCHAR) period, l_partkey p, row_number() OVER (PARTITION BY year(o_orderdate), l_partkey) k
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') WHERE k = 1), f AS (SELECT DISTINCT l_suppkey, l_partkey p FROM lineitem)
SELECT l_suppkey, period, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, period) k FROM (SELECT l_suppkey, period, count(*) n FROM f JOIN y USING (p) GROUP BY 1, 2)) WHERE k = 1""")
def overlap_best(spark, d):
    li = table(spark, d, "lineitem")
    years = li.where("l_returnflag = 'R'").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.year("o_orderdate").cast("string").alias("period"), "l_partkey").distinct()
    both = li.select("l_suppkey", "l_partkey").distinct().join(years, "l_partkey").groupBy("l_suppkey", "period").agg(F.count("*").alias("n"))
    return J.latest_per_key(both, ["l_suppkey"], [F.desc("n"), "period"])


@query("SELECT l_returnflag, s_suppkey IS NOT NULL AS resolved, count(*) n, round(sum(l_extendedprice), 2) total FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = l_suppkey GROUP BY 1, 2")
def resolve_and_split(spark, d):
    walk = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select("s_suppkey")
    joined = table(spark, d, "lineitem").join(walk, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.groupBy("l_returnflag", F.col("s_suppkey").isNotNull().alias("resolved")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 6 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def partial_update(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    update = base.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("new").alias("s_name"), F.when(F.col("s_suppkey") % 3 == 0, 0.0).alias("s_acctbal"))
    return M.partial_update(base, update, "s_suppkey")


@query("""SELECT l_returnflag, count(*) n, count(k) filled, sum(k) total FROM (SELECT l_returnflag, CASE WHEN l_orderkey % 3 <> 0 OR (l_partkey % 5 <> 0 AND min(l_suppkey) OVER w = max(l_suppkey) OVER w) THEN l_suppkey END k
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, l_partkey)) GROUP BY 1""")
def crosswalk_backfill(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_suppkey")
    walk = li.where("l_partkey % 5 <> 0").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("known")).dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey"])
    own = li.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_suppkey")))
    # lines of one order may share number and part; their suppliers agree only where the walk is unique
    single = li.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")).where("a = b")
    filled = M.crosswalk_backfill(own, walk.join(single, ["l_orderkey", "l_linenumber", "l_partkey"], "left_semi"), ["l_orderkey", "l_linenumber", "l_partkey"], "l_suppkey", "known")
    return filled.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("l_suppkey").alias("filled"), F.sum("l_suppkey").alias("total"))


@query("""WITH a AS (SELECT p_partkey, p_brand FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_brand END p_brand FROM part WHERE p_partkey % 7 <> 0)
SELECT action, count(*) n FROM (SELECT CASE WHEN a.p_partkey IS NULL THEN 'insert' WHEN b.p_partkey IS NULL THEN 'deactivate' WHEN a.p_brand <> b.p_brand THEN 'update' ELSE 'same' END action
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey) GROUP BY 1""")
def reference_sync(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    new = part.where("p_partkey % 7 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_brand")))
    return M.reference_sync(part.where("p_partkey % 5 <> 0"), new, "p_partkey", ["p_brand"]).groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 30), b AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size > 20)
SELECT *, 'missing' drift FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def drift_except(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_size")
    return M.drift(part.where("p_size < 30").distinct(), part.where("p_size > 20").distinct())


@query(U + """, x AS (SELECT entity, CASE WHEN entity % 3 = 0 THEN 'longlist' ELSE 'new' END stage FROM u WHERE entity % 2 = 0 GROUP BY 1), c AS (SELECT entity FROM u GROUP BY 1 HAVING sum(m1) > 1000000)
SELECT stage, count(*) n FROM (SELECT CASE WHEN c.entity IS NOT NULL THEN 'longlist' WHEN stage = 'longlist' THEN 'filtered_out' ELSE stage END stage FROM x FULL JOIN c ON c.entity = x.entity) GROUP BY 1""")
def stage_sync(spark, d):
    u = units(spark, d)
    existing = u.where("entity % 2 = 0").select("entity").distinct().withColumn("stage", F.when(F.col("entity") % 3 == 0, "longlist").otherwise("new"))
    return M.stage_sync(existing, u.groupBy("entity").agg(F.sum("m1").alias("s")).where("s > 1000000"), "entity").groupBy("stage").agg(F.count("*").alias("n"))


@query(SU + "SELECT entity, segment, total FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY total DESC, segment) k FROM (SELECT entity, segment, round(sum(m1), 2) total FROM s GROUP BY 1, 2)) WHERE k = 1")
def best_row_per_entity(spark, d):
    return J.latest_per_key(supply(spark, d).groupBy("entity", "segment").agg(F.round(F.sum("m1"), 2).alias("total")), ["entity"], [F.desc("total"), "segment"])


# scalar functions

@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM part")
def text_key(spark, d):
    return table(spark, d, "part").select("p_partkey", S.text_key(F.col("p_name")).alias("key"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'id:' || c_custkey WHEN c_custkey % 3 = 1 THEN 'name:' || c_name || '|team:' || c_mktsegment ELSE 'name:' || c_name END AS key FROM customer")
def lookup_key(spark, d):
    k = F.col("c_custkey") % 3
    return table(spark, d, "customer").select("c_custkey", S.lookup_key(F.when(k == 0, F.col("c_custkey")), F.col("c_name"), F.when(k == 1, F.col("c_mktsegment"))).alias("key"))


@query("SELECT coalesce(canonical, n_name) AS name, count(*) n FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (VALUES ('UNITED STATES', 'USA'), ('UNITED KINGDOM', 'UK'), ('NATION_0', 'N0'), ('NATION_1', 'N0')) a(alias, canonical) ON alias = n_name GROUP BY 1")
def alias_canonical(spark, d):
    aliases = spark.createDataFrame([("UNITED STATES", "USA"), ("UNITED KINGDOM", "UK"), ("NATION_0", "N0"), ("NATION_1", "N0")], "alias string, canonical string")
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return named.join(F.broadcast(aliases), F.col("alias") == F.col("n_name"), "left").groupBy(F.coalesce("canonical", "n_name").alias("name")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CAST(round(CAST(round(abs(c_acctbal), 2) AS DECIMAL(20, 6)) * CASE c_custkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END
 * CASE c_custkey % 2 WHEN 0 THEN CAST(1.17 AS DECIMAL(10, 6)) ELSE CAST(1 AS DECIMAL(10, 6)) END, 2) AS DOUBLE) AS eur FROM customer""")
def money_parse(spark, d):
    k = F.col("c_custkey")
    amount = F.format_string("%.2f", F.abs(F.round("c_acctbal", 2)))
    text = F.concat(F.when(k % 2 == 0, "£").otherwise("€"), amount, F.when(k % 3 == 0, "k").when(k % 3 == 1, "m").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", S.money_to_eur(text, {"£": 1.17, "€": 1.0}).cast("double").alias("eur"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE event_id / 4.0 END AS number FROM events")
def tolerant_cast(spark, d):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat((k % 100).cast("string"), F.lit("%"))).when(k % 4 == 1, "").when(k % 4 == 2, "x").otherwise(F.concat(F.lit(" "), (k / 4.0).cast("string")))
    return table(spark, d, "events").select("event_id", S.tolerant_double(text).alias("number"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_multi_format(spark, d):
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy", "dd.MM.yyyy"]
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", formats[0])).when(k == 1, F.date_format("o_orderdate", formats[1])).when(k == 2, F.date_format("o_orderdate", formats[2])).otherwise(F.date_format("o_orderdate", formats[3]))
    return table(spark, d, "orders").select("o_orderkey", S.date_of_formats(text, formats).alias("day"))


@query("SELECT CAST(year(o_orderdate) - CAST(month(o_orderdate) < 7 AS INT) AS INT) AS fiscal, count(*) n FROM orders GROUP BY 1")
def fiscal_period(spark, d):
    return table(spark, d, "orders").groupBy(S.fiscal_year(F.col("o_orderdate")).alias("fiscal")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_id % 2 = 0 THEN value * 2 END, 0.0) AS v FROM events")
def alias_coalesce(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.when(F.col("event_type") == "view", F.col("value")), F.when(F.col("event_id") % 2 == 0, F.col("value") * 2), F.lit(0.0)).alias("v"))


@query(U + f"SELECT entity, round(date_diff('day', CAST(min(ts) AS DATE), DATE '{AS_OF}') / 365.25, 2) AS age FROM u GROUP BY 1")
def age_years(spark, d):
    return units(spark, d).groupBy("entity").agg(F.min("ts").alias("t")).select("entity", S.age_years(F.col("t"), F.lit(AS_OF).cast("date")).alias("age"))


@query("SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'std' WHEN p_type LIKE 'SM%' THEN 'small' WHEN p_type LIKE 'S%' THEN 's' WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE 'other' END AS bucket, count(*) n FROM part GROUP BY 1")
def prefix_bucket(spark, d):
    groups = {"S": "s", "SM": "small", "STANDARD": "std", "PROMO": "promo"}
    return table(spark, d, "part").groupBy(S.prefix_bucket(F.col("p_type"), groups, "other").alias("bucket")).agg(F.count("*").alias("n"))


@query(SU + "SELECT entity, CAST(line AS INT) AS grid_row, CAST(exposure AS INT) AS grid_col, count(*) n FROM s GROUP BY 1, 2, 3")
def regex_pair(spark, d):
    row, col = S.grid_pair(F.concat_ws(":", F.col("line").cast("string"), F.col("exposure").cast("int").cast("string")))
    return supply(spark, d).groupBy("entity", row.alias("grid_row"), col.alias("grid_col")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(regexp_matches(lower(text), 'license|copyright|http|%%%|!!'), false) AS hit FROM documents")
def any_of_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", S.any_of_terms(F.col("text"), ["license", "copyright", "http", "%%%", "!!"]).alias("hit"))


@query(E + "SELECT entity, rup(CASE WHEN sum(value) >= 45 THEN max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / (sum(value) / 90) END, 4) AS rate FROM e GROUP BY 1")
def json_metric_rate(spark, d):
    g = events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("double")).groupBy("entity").agg(F.max("k").alias("k"), F.sum("value").alias("x"))
    payload = F.create_map(F.lit("k_total"), F.col("k").cast("string"))
    return g.select("entity", r4(S.metric_rate(payload, ["k_per_90", "k_total"], F.col("x")), "rate"))


SCORE_MAPS_SQL = U + """, g AS (SELECT entity, avg(m1) a, stddev_pop(m1) sd, count(*) n, avg(CASE WHEN label = '1-URGENT' THEN m1 END) top FROM u GROUP BY 1)
SELECT entity, rup(least(greatest(100 / (1 + sd / a), 0), 100), 4) consistency, rup(CASE WHEN top IS NULL THEN 50 ELSE least(greatest(50 * top / a, 0), 100) END, 4) ratio FROM g"""


@query(SCORE_MAPS_SQL)
def score_maps(spark, d):
    g = units(spark, d).groupBy("entity").agg(F.avg("m1").alias("a"), F.stddev_pop("m1").alias("sd"), F.avg(F.when(F.col("label") == "1-URGENT", F.col("m1"))).alias("top"))
    return g.select("entity", r4(S.consistency_score(F.col("sd") / F.col("a")), "consistency"), r4(S.ratio_score(F.col("top"), F.col("a")), "ratio"))


BAL = "(c_acctbal + 1000) / 110"


@query(f"""SELECT c_custkey, rup(CASE WHEN x <= 0 THEN 0 WHEN x <= 2.7 THEN 30 * x / 2.7 WHEN x <= 3.88 THEN 30 + 20 * (x - 2.7) / (3.88 - 2.7)
 WHEN x <= 6.29 THEN 50 + 30 * (x - 3.88) / (6.29 - 3.88) ELSE 80 + 20 * (1 - exp(-(x - 6.29) / 3.0)) END, 4) AS score FROM (SELECT c_custkey, {BAL} / 10 AS x FROM customer)""")
def calibrate_piecewise(spark, d):
    return table(spark, d, "customer").select("c_custkey", r4(S.calibrated(F.expr(BAL) / 10, 2.7, 3.88, 6.29), "score"))


@query(f"SELECT c_custkey, rup(least(greatest(100 * (1 - exp(-greatest({BAL}, 0) / 19.0)), 0), 100), 4) AS score FROM customer")
def board_score(spark, d):
    return table(spark, d, "customer").select("c_custkey", r4(S.board_score(F.expr(BAL)), "score"))


#: Action tiers and their lowest scores.
TIERS = [("Tier 1", 40.0), ("Tier 2", 34.0), ("Tier 3", 28.0), ("Tier 4", 22.0), ("Tier 5", 0.0)]


@query(f"SELECT CASE WHEN x >= 40 THEN 'Tier 1' WHEN x >= 34 THEN 'Tier 2' WHEN x >= 28 THEN 'Tier 3' WHEN x >= 22 THEN 'Tier 4' ELSE 'Tier 5' END AS tier, count(*) n FROM (SELECT {BAL} x FROM customer) GROUP BY 1")
def tier_bucket(spark, d):
    return table(spark, d, "customer").groupBy(S.tier_of(F.expr(BAL), TIERS).alias("tier")).agg(F.count("*").alias("n"))


@query(U + """SELECT entity, period, round(sum(exposure), 2) total, count(*) n, CASE WHEN count(*) < 10 THEN 'very_low' WHEN count(*) < 20 THEN 'low' WHEN count(*) < 30 THEN 'medium' ELSE 'high' END tier,
 rup(count(*) / (count(*) + 10.0), 4) shrinkage, rup(greatest(0.35, sqrt(least(1, sum(exposure) / 900))), 4) evidence, sum(exposure) < 500 limited FROM u WHERE exposure > 0 GROUP BY 1, 2""")
def confidence(spark, d):
    from cohortrank.plans.features import confidence as plan

    return plan(units(spark, d)).select("entity", "period", F.round("total", 2).alias("total"), "n", "tier", r4(F.col("shrinkage"), "shrinkage"), r4(F.col("evidence"), "evidence"), "limited")


@query(U + "SELECT entity, rup(avg(m1) / 1000 * (count(*) / (count(*) + 10.0)) + 50 * (1 - count(*) / (count(*) + 10.0)), 4) AS score FROM u GROUP BY 1")
def shrinkage(spark, d):
    g = units(spark, d).groupBy("entity").agg(F.avg("m1").alias("a"), F.count("*").alias("n"))
    return g.select("entity", r4(S.shrink_to(F.col("a") / 1000, F.lit(50.0), S.shrinkage_factor(F.col("n"))), "score"))


@query("""SELECT p_partkey, rup(greatest(5, CASE WHEN a <= 24 THEN 100 WHEN a <= 28 THEN 100 - 5 * (a - 24) / 4.0 WHEN a <= 32 THEN 95 - 25 * (a - 28) / 4.0
 WHEN a <= 34 THEN 70 - 45 * (a - 32) / 2.0 ELSE 25 - 8 * (a - 34) END), 4) AS score FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) a FROM part)""")
def age_curve_score(spark, d):
    return table(spark, d, "part").select("p_partkey", r4(S.age_curve_score(F.col("p_size").cast("double"), F.lit(24.0), F.lit(28.0), F.lit(32.0)), "score"))


@query("""SELECT s_suppkey, rup(least(greatest(CASE s_nationkey % 4 WHEN 0 THEN 900 WHEN 1 THEN 500 ELSE 100 END, v * CASE s_nationkey % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.1 ELSE 0.05 END), v * 0.4), 4) AS wage
FROM (SELECT *, abs(s_acctbal) v FROM supplier)""")
def floor_cap_estimate(spark, d):
    v, k = F.abs("s_acctbal"), F.col("s_nationkey") % 4
    ratio, floor = F.when(k == 0, 0.2).when(k == 1, 0.1).otherwise(0.05), F.when(k == 0, 900.0).when(k == 1, 500.0).otherwise(100.0)
    return table(spark, d, "supplier").select("s_suppkey", r4(S.floor_cap_estimate(v, ratio, floor), "wage"))


@query(U + """, g AS (SELECT entity, round(avg(m1), 2) x FROM u GROUP BY 1), k AS (SELECT x, row_number() OVER (ORDER BY x) - 1 i, count(*) OVER () n FROM g)
SELECT p, round(x, 1) AS value FROM k JOIN (VALUES (0.5), (0.75), (0.9)) q(p) ON i = round_even((n - 1) * CAST(p AS DOUBLE), 0)""")
def board_percentiles(spark, d):
    """Nearest-rank values; the ranks come from counts per value, not from one global sort."""
    g = units(spark, d).groupBy("entity").agg(F.round(F.avg("m1"), 2).alias("x"))
    n = g.agg(F.count("*").alias("n"))
    ordered = written_once(g.repartitionByRange("x").withColumn("_p", F.spark_partition_id()), "ordered")  # so that all parts see one numbering
    local = ordered.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy("x")))
    starts = local.groupBy("_p").agg(F.count("*").alias("c")).withColumn("_before", F.coalesce(F.sum("c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = local.join(F.broadcast(starts.select("_p", "_before")), "_p").select("x", (F.col("_before") + F.col("_i") - 1).alias("i"))
    ps = spark.createDataFrame([("0.50",), ("0.75",), ("0.90",)], "p string").select(F.col("p").cast("decimal(3,2)").alias("p"))
    wanted = ps.crossJoin(n).select("p", F.bround((F.col("n") - 1) * F.col("p").cast("double"), 0).cast("long").alias("i"))
    return at.join(F.broadcast(wanted), "i").select("p", F.round("x", 1).alias("value"))


@query(U + "SELECT entity, round(avg(m1) / 1000 * CASE WHEN cohort % 5 = 0 THEN 1 ELSE 0.9 + 0.01 * (cohort % 5) END, 2) * 1.0 AS adjusted, rup(0.55 + 0.45 * greatest(0.35, sqrt(least(1, sum(exposure) / 900))), 4) AS soft FROM u GROUP BY entity, cohort")
def strength_adjust(spark, d):
    g = units(spark, d).groupBy("entity", "cohort").agg(F.avg("m1").alias("a"), F.sum("exposure").alias("x"))
    factor = F.when(F.col("cohort") % 5 != 0, 0.9 + 0.01 * (F.col("cohort") % 5))
    return g.select("entity", S.strength_adjusted(F.col("a") / 1000, factor).alias("adjusted"), r4(S.soft_multiplier(S.evidence_multiplier(F.col("x"))), "soft"))


@query()
def fuzzy_match(spark, d):
    """Perturbed part names against all names of their brand and size, through the block's index of words."""
    from cohortrank.operators.names import best_names

    part = table(spark, d, "part")
    block = ["p_brand", "p_size"]
    twisted = F.concat(F.reverse(F.substring("p_name", 1, 2)), F.substring("p_name", 3, 100))
    asked = written_once(part.select(F.col("p_partkey").alias("asked"), S.text_key(twisted).alias("name"), *block), "asked")
    known = written_once(part.select("p_partkey", S.text_key(F.col("p_name")).alias("name"), *block), "known")
    return best_names(asked, known, "asked", "p_partkey", block, S.name_similarity, 0.0).select("asked", "p_partkey", F.col("score").alias("similarity"))


@query(U + """, g AS (SELECT entity, cohort % 4 + 1 AS lvl, avg(CAST(label IN ('1-URGENT', '2-HIGH') AS DOUBLE)) share, count(*) n FROM u GROUP BY 1, 2)
SELECT entity, points, CASE WHEN points >= 15 THEN 'green' WHEN points >= 10 THEN 'amber' ELSE 'red' END AS status FROM (
 SELECT entity, CASE WHEN lvl = 1 AND share >= 0.8 THEN 12 WHEN lvl = 1 AND share >= 0.4 THEN 8 WHEN lvl = 2 AND share >= 0.4 THEN 6 WHEN share >= 0.2 THEN 3 ELSE 0 END + CASE WHEN n >= 12 THEN 7 WHEN n >= 6 THEN 4 ELSE 0 END AS points FROM g)""")
def points_status(spark, d):
    from cohortrank.plans.features import points_status as plan

    g = units(spark, d).groupBy("entity", (F.col("cohort") % 4 + 1).alias("level")).agg(F.avg(F.col("label").isin("1-URGENT", "2-HIGH").cast("double")).alias("share"), F.count("*").alias("caps"))
    return plan(g).select("entity", "points", "status")


# projections and filters

@query(U + "SELECT unit, rup(m1 / exposure * 90, 4) m1_rate, rup(m2 / exposure * 90, 4) m2_rate, rup(m3 / exposure * 90, 4) m3_rate, exposure < 20 AS low_exposure FROM u WHERE exposure >= 1")
def per_exposure_rate(spark, d):
    return A.per_exposure(units(spark, d), ["m1", "m2", "m3"]).select("unit", *(r4(F.col(f"{m}_rate"), f"{m}_rate") for m in ("m1", "m2", "m3")), "low_exposure")


@query(U + "SELECT DISTINCT entity, period FROM u WHERE cohort IN (1, 2, 3, 4) AND (segment = 'BUILDING' OR label = '1-URGENT') AND period = '1998'")
def universe_filter(spark, d):
    u = units(spark, d).where(F.col("cohort").isin(1, 2, 3, 4) & (F.col("period") == "1998"))
    return u.where((F.col("segment") == "BUILDING") | (F.col("label") == "1-URGENT")).select("entity", "period").distinct()


@query(U + "SELECT entity, round(sum(exposure), 2) total FROM u WHERE period = '1998' AND segment IN ('BUILDING', 'MACHINERY') GROUP BY 1 HAVING sum(exposure) >= 30 ORDER BY total DESC, entity LIMIT 50")
def candidate_pool(spark, d):
    u = units(spark, d).where((F.col("period") == "1998") & F.col("segment").isin("BUILDING", "MACHINERY"))
    return u.groupBy("entity").agg(F.round(F.sum("exposure"), 2).alias("total")).where("total >= 30").orderBy(F.desc("total"), "entity").limit(50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE contains(CAST(o_orderdate AS VARCHAR), '1998-03')")
def text_window_filter(spark, d):
    return table(spark, d, "orders").where(F.contains(F.col("o_orderdate").cast("string"), F.lit("1998-03"))).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 24 OFFSET 24")
def page_slice(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(24).limit(24)
