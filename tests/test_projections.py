import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cohortrank.models import projections as P
from cohortrank.models.estimators import TooFewRows, classifier

SCHEMA = "id long, a double, b double, origin string, goal string, rate double, other double, starts int"
ARGS = {"key": ["id"], "numbers": ["a", "b"], "labels": ["origin", "goal"], "targets": ["rate", "other"], "starter": "starts", "pair": ["origin", "goal"]}


def rows(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        a, b, o = rng.uniform(0, 10), rng.gauss(0, 1), rng.choice("xyz")
        rate = 20 + 2 * a + {"x": 0, "y": 3, "z": 6}[o] + rng.gauss(0, 2)
        other = 50 + 3 * abs(b) + rng.gauss(0, 1 + 0.1 * a)
        out.append((i, a if i % 50 else None, b, o, "h", rate, other if i % 9 else None, int(a + rng.gauss(0, 2) > 5)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    return P.fit_targets(spark.createDataFrame(rows(1500, 1), SCHEMA), **ARGS)


def test_intervals_hold_four_fifths_of_rows_not_seen(spark, fitted):
    out = P.project_targets(spark.createDataFrame(rows(1500, 2), SCHEMA), fitted)
    inside = lambda t: F.avg(F.col(t).between(F.col(f"{t}_p10"), F.col(f"{t}_p90")).cast("double"))
    r = out.agg(inside("rate").alias("rate"), inside("other").alias("other"), F.corr("starter_chance", "starts").alias("c"), F.avg("starter_chance").alias("m"), F.avg("starts").alias("s")).first()
    assert 0.75 <= r.rate <= 0.85 and 0.75 <= r.other <= 0.85 and r.c > 0.6 and abs(r.m - r.s) < 0.04
    assert out.count() == 1500 and out.where("rate_p10 > rate_p50 OR rate_p50 > rate_p90 OR other_p10 > other_p50 OR other_p50 > other_p90").count() == 0


def test_missing_columns_and_unseen_labels(spark, fitted):
    few = spark.createDataFrame([(1, "new", 5.0), (2, "", None), (3, "x", 1.0)], "id long, origin string, a double")
    out = {r.id: r for r in P.project_targets(few, fitted).collect()}
    assert len(out) == 3 and all(r.rate_p50 is not None and 0 <= r.starter_chance <= 1 and r.low_sample and r.pair_rows == 0 for r in out.values())
    known = P.project_targets(few.withColumn("goal", F.lit("h")), fitted).where("id = 3").first()
    assert known.pair_rows > 400 and not known.low_sample
    assert P.project_targets(few.limit(0), fitted).count() == 0


def test_models_score_in_a_session_that_has_used_an_observation(spark, fitted):
    seen, few = Observation(), spark.createDataFrame(rows(60, 4), SCHEMA)
    few.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 60
    assert len(P.project_targets(few, fitted).collect()) == 60
    for trees in (False, True):
        assert len(classifier(few, ["a", "b"], "starts", trees).transform(few).select("probability").collect()) == 60


def test_few_rows_raise(spark):
    with pytest.raises(TooFewRows):
        P.fit_targets(spark.createDataFrame(rows(10, 3), SCHEMA), **ARGS)
