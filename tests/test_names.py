import difflib
import random

import pytest
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.operators import joins as J
from cohortrank.operators import names as K
from cohortrank.queries import queries
from cohortrank.queries.adapters import table
from cohortrank.queries.shapes import keyed_names, resolution_sources

PATH = "/root/testdata/sf0.001"


def exhaustive(left, right, a, b, block, measure, least):
    """Best of all pairs of a block."""
    pairs = left.join(right.withColumnRenamed("name", "other"), block)
    rated = pairs.withColumn("score", F.round(measure(F.col("name"), F.col("other")), 4)).where(F.col("score") >= least)
    return {r[a]: (r[b], r["score"]) for r in J.latest_per_key(rated, [a], [F.desc("score"), b]).collect()}


def test_units_meet_as_in_all_pairs(spark):
    e = table(spark, PATH, "orders").join(table(spark, PATH, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumns({"day": F.to_date("o_orderdate"), "other": F.concat(F.lower("c_name"), F.lit(" fc"))})
    a, b = keyed_names(e, "other", "a", "o_orderkey", ["day"]), keyed_names(e, "c_name", "b", "o_orderkey", ["day"])
    assert {r.a: (r.b, r.score) for r in queries()["unit_reconcile"](spark, PATH).collect()} == exhaustive(a, b, "a", "b", ["day"], S.name_similarity, 0.65)


def test_parts_meet_as_in_all_pairs(spark):
    part, block = table(spark, PATH, "part"), ["p_brand", "p_size"]
    twisted = F.concat(F.reverse(F.substring("p_name", 1, 2)), F.substring("p_name", 3, 100))
    a = part.select(F.col("p_partkey").alias("asked"), S.text_key(twisted).alias("name"), *block)
    b = part.select("p_partkey", S.text_key(F.col("p_name")).alias("name"), *block)
    assert {r.asked: (r.p_partkey, r.similarity) for r in queries()["fuzzy_match"](spark, PATH).collect()} == exhaustive(a, b, "asked", "p_partkey", block, S.name_similarity, 0.0)


def test_entities_resolve_as_in_all_pairs(spark):
    records, entities, walk = resolution_sources(spark, PATH)
    held = {r.entity_id: (r.name, r.cohort, r.segment) for r in entities.collect()}
    saved, want = {r.entity_id for r in walk.collect()}, {}
    for r in records.collect():
        if r.record in saved:
            want[r.record] = (r.record, 1.0, 1)
            continue
        for stage, own, at in ((2, r.cohort, 1), (3, r.segment, 2)):
            pool = {i: n[0] for i, n in held.items() if own is not None and n[at] == own}
            last = {i: n for i, n in pool.items() if n.split()[-1] == r.name.split()[-1]}
            pool = {i: n for i, n in last.items() if n[0] == r.name[0]} or last or pool
            best = min(((-round(difflib.SequenceMatcher(None, r.name, n).ratio(), 4), i) for i, n in pool.items()), default=(0, None))
            if -best[0] >= 0.72:
                want[r.record] = (best[1], -best[0], stage)
                break
    got = {r.record: (r.entity_id, r.score, r.stage) for r in queries()["entity_resolution"](spark, PATH).collect()}
    assert {k: (e, st) for k, (e, _, st) in got.items()} == {k: (e, st) for k, (e, _, st) in want.items()}


def test_pairs_compared_grow_with_the_names(spark):
    """Names of a common word and one of their own: two sides of n names give about n pairs, not n * n."""
    def compared(n):
        a = spark.range(n).select(F.lit(1).alias("k"), F.concat(F.lit("club "), F.col("id").cast("string"), F.lit("q")).alias("name"))
        return K.rare_pairs(a, a, ["k"]).count()

    assert (compared(300), compared(3000)) == (300, 3000)


@pytest.mark.parametrize("hot", [2, 1000])
def test_prefixes_keep_names_that_share_most_words(spark, monkeypatch, hot):
    monkeypatch.setattr(K, "HOT", hot)
    rng = random.Random(hot)
    make = lambda: " ".join(dict.fromkeys(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(1, 7))))
    left, right = ({make() for _ in range(150)} for _ in range(2))
    frame = lambda names: spark.createDataFrame([(1, n) for n in names], "k int, name string")
    got = {(r["name"], r.other) for r in K.rare_pairs(frame(left), frame(right), ["k"]).collect()}
    for x in left:
        for y in right:
            a, b = set(x.split()), set(y.split())
            if len(a & b) >= 0.8 * max(len(a), len(b)) or a <= b or b <= a:
                assert (x, y) in got


def test_surnames_and_initials(spark):
    frame = lambda names: spark.createDataFrame([(1, n) for n in names], "k int, name string")
    got = {(r["name"], r.other) for r in K.surname_pairs(frame(["jo smith", "al gray", "x", ""]), frame(["john smith", "ann smith", "bo gray", "cy gray", "zed"]), ["k"]).collect()}
    assert got == {("jo smith", "john smith"), ("al gray", "bo gray"), ("al gray", "cy gray")}


def test_roster_similarity_takes_the_strongest_rule(spark):
    cases = [("john smith", "j smith", 0.9), ("smith john", "john smith", 0.95), ("ann smith", "bo smith", 0.83), ("bo x y", "x y bo", 0.95), ("al b", "xx b", 0.82), ("a b", "b a", 0.95), ("ab cde", "cde fg ab", 0.88), ("", "a", 0.0), (None, "a", 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    for r in df.select("i", S.roster_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b, want = cases[r.i]
        ratio = difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        assert r.s == max(want, ratio)


def test_terms_are_never_broadcast(spark, monkeypatch):
    """Files of names may be small enough to be broadcast where what the names explode to is not."""
    plans, keep = [], K.written_once
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(K, "written_once", lambda df, name: plans.append(plan(df)) or keep(df, name))
    a = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("a"), F.concat(F.lit("club "), F.col("id").cast("string"), F.lit("q")).alias("name"))
    best = K.best_names(a, a.withColumnRenamed("a", "b"), "a", "b", ["k"], S.name_similarity, 0.6, surnames=True)
    plans.append(plan(best))
    assert best.count() == 200 and len(plans) > 8
    assert not [p for p in plans if "Broadcast" in p]


def test_resolution_broadcasts_nothing(spark, monkeypatch):
    """Records, saved pairs and what the stages resolve grow with the input, too."""
    plans, keep = [], K.written_once
    once = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name)
    monkeypatch.setattr(K, "written_once", once)
    monkeypatch.setattr(J, "written_once", once)
    assert queries()["entity_resolution"](spark, PATH).count() == table(spark, PATH, "customer").count()
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]
