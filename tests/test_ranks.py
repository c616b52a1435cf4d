import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from cohortrank.operators import aggregates as A
from cohortrank.operators import ranks as R
from cohortrank.operators import windows as N
from cohortrank.plans import workflow as V
from cohortrank.queries import queries


def test_ranks_equal_a_sort(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, -3.0, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(5)
    got = {r.id: (r["_below"], r["_ties"], r["_n"]) for r in R.with_ranks(df, ["g"], ["x"]).collect()}
    least = float("-inf")
    value = lambda x: least if x is None else x
    for i, g, x in rows:
        own = [value(y) for _, h, y in rows if h == g]
        assert got[i] == (sum(y < value(x) for y in own), own.count(value(x)), len(own))
    a, b = ({r.id: round(r.percentile, 9) for r in N.member_percentile(df, ["g"], "x", wide=w).collect()} for w in (False, True))
    assert a == b


def test_a_group_of_a_million_rows_lies_in_many_tasks(spark):
    """One group: its ranges fill all partitions, and its ranks and area are those of a sort."""
    n = 1_000_000
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        df = spark.range(n).select(F.lit("g").alias("g"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("hit"))
        counted = df.groupBy("g", "x").count().repartitionByRange("g", "x")
        sizes = [r["n"] for r in counted.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 4 and max(sizes) < 0.4 * n
        r = R.with_ranks(df, ["g"], ["x"]).agg(F.count_if(F.col("_below") == F.col("x")).alias("right"), F.max("_n").alias("n")).first()
        assert (r.right, r.n) == (n, n)
        bins = {r["bin"]: r["n"] for r in N.equal_count_bins(df, ["x"], 10, ["g"]).groupBy("bin").agg(F.count("*").alias("n")).collect()}
        assert len(bins) == 10 and max(bins.values()) - min(bins.values()) <= 2
        assert 0.49 < V.rank_auc(df, ["g"], "x", "hit").first().auc < 0.51
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_area_with_ties_and_one_class(spark):
    rows = [("a", 1, 0), ("a", 1, 1), ("a", 2, 1), ("a", 0, 0), ("b", 1, 1), ("c", 5, None), ("c", 1, 0), ("c", 6, 1)]
    got = {r.g: (r.positives, r.negatives, r.auc) for r in V.rank_auc(spark.createDataFrame(rows, "g string, s int, h int"), ["g"], "s", "h").collect()}
    assert got["a"] == (2, 2, 0.875) and got["b"] == (1, 0, None) and got["c"][:2] == (1, 1)


def test_entities_of_equal_units_tie_in_any_order_of_rows(spark, tmp_path):
    """24 entities with the same four units in all orders; their mean rate lies on a tie of the sixth digit."""
    values = [(58034.16, 12.0), (321279.77, 136.0), (115865.59, 80.0), (95922.66, 10.0)]
    orders, lines = [], []
    for entity, own in enumerate(itertools.permutations(values)):
        for k, (price, quantity) in enumerate(own):
            unit = 4 * entity + k
            orders.append((unit, entity, "O", 0.0, dt.datetime(1999, 5, 1), "5-LOW"))
            lines.append((unit, quantity, price, 0.0))
    for name, rows, schema in (
        ("customer", [(i, f"c{i}", 0, "BUILDING") for i in range(24)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.percentile for r in queries()["midrank_percentile"](spark, str(tmp_path)).collect()] == [50.0] * 24


def test_exact_mean_of_odd_values(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", None), ("a", 2.5), ("b", None), ("c", 1e300), ("c", 3e300), ("d", float("nan")), ("d", 1.0), ("e", -0.1), ("e", 0.1)], "g string, x double")
    got = {r.g: r.m for r in df.groupBy("g").agg(A.exact_mean(F.col("x")).alias("m")).collect()}
    assert (got["a"], got["b"], got["c"], got["e"]) == (2.0, None, 2e300, 0.0) and got["d"] != got["d"]


def test_percentiles_by_ranges_equal_those_of_one_task(spark):
    rng, shares = random.Random(9), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for values in ([rng.gauss(0, 3) for _ in range(501)], [1.0, 1.0, None, 2.0], [7.5], [None]):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        want = df.select(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0] or [None] * len(shares)
        assert R.exact_percentiles(df, "x", shares) == want


def test_residuals_are_not_gathered_in_one_row(spark, monkeypatch):
    from cohortrank.models import estimators as L

    def refuse(*_):
        raise AssertionError("all residuals in one task")

    monkeypatch.setattr(L.F, "percentile", refuse)
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 2.0 + F.col("id") % 7).alias("y"))
    low, high = L.projection(df, ["a"], ["g"], "y")[1]
    assert low < 0 < high
