import math
import random

from pyspark.sql import functions as F

from cohortrank.models import chances as C
from cohortrank.queries import queries

PATH = "/root/testdata/sf0.001"


def test_chances_sum_to_the_hits_and_factors_to_the_logit(spark):
    rng = random.Random(2)
    rows = []
    for i in range(2000):
        a, b, s = rng.choice([1.0, 2.0, 3.0, None]), float(rng.randint(0, 4)), rng.choice(["home", "away", None])
        rows.append((i, a, b, s, int(rng.random() < 1 / (1 + math.exp(-(0.6 * (a or 2) - 0.4 * b + (s == "home") - 0.8))))))
    df = spark.createDataFrame(rows, "id long, a double, b double, s string, hit int")
    model = C.fitted(df, ["a", "b"], ["s"], "hit")
    out = C.chances(df, model, ["a", "b"], ["s"]).collect()
    assert abs(sum(r.chance for r in out) - sum(r.hit for r in out)) < 0.05
    for r in out:
        assert abs(sum(f.value for f in r.factors) + r.rest - r.logit) < 1e-9 and abs(r.chance - 1 / (1 + math.exp(-r.logit))) < 1e-12
        assert [abs(f.value) for f in r.factors] == sorted((abs(f.value) for f in r.factors), reverse=True) and len(r.factors) <= 5
    signs = {f.factor: f.value for r in out if r.a == 3.0 and r.b == 4.0 and r.s == "home" for f in r.factors}
    assert signs["a"] > 0 > signs["b"]
    new = C.chances(spark.createDataFrame([(1, 2.0, 1.0, "neutral")], "id long, a double, b double, s string"), model, ["a", "b"], ["s"]).first()
    assert 0 < new.chance < 1


def test_rule_and_sparse_histories(spark):
    df = spark.createDataFrame([(1, 0.0, None, 0, None, None, 3, None), (2, 0.9, 0.5, 4, 0.5, 100, 20, 90)], "id int, rate double, latest double, episodes int, repeats double, longest int, continuity int, days int")
    told = C.rule(*(F.col(c) for c in ("rate", "latest", "episodes", "repeats", "longest", "continuity", "days")))
    a, b = df.select("id", told["chance"].alias("chance"), told["factors"].alias("factors"), C.sparse(F.col("episodes"), F.lit(0), F.col("longest"), F.col("repeats")).alias("sparse")).orderBy("id").collect()
    assert (round(a.chance, 6), a.sparse, b.sparse) == (round(0.52 + 0.38 * 0.7 + 0.054, 6), True, False)
    assert round(b.chance, 6) == round(0.52 + 0.38 * 0.9 - 0.14 - 0.07 - 0.15 + 0.18 + 0.04, 6)
    assert [f.factor for f in b.factors] == ["continuity", "rate", "longest", "episodes", "repeats"]


def test_models_on_the_tables(spark):
    shots = queries()["shot_chances"](spark, PATH).agg(F.sum("expected").alias("e"), F.sum("hits").alias("h")).first()
    assert abs(shots.e - shots.h) < 0.01 * shots.h
    risk = queries()["availability_risk"](spark, PATH).collect()
    assert len(risk) == len({r.entity for r in risk}) > 0 and all(0 <= r.chance <= 1 and len(r.factors) == 5 for r in risk) and {r.source for r in risk} <= {"model", "rule"}
