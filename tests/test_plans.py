import datetime

import pytest
from pyspark.sql import functions as F

from cohortrank.plans import features as P
from cohortrank.plans import gates as G
from cohortrank.plans import scoring as C
from cohortrank.plans import workflow as V


def test_layer_weights_keep_the_scale():
    w = C.layer_weights("promotion_accelerator")
    assert sum(w.values()) == pytest.approx(0.85) and w["role_fit"] == pytest.approx(0.2 * 0.85 / 0.6)
    mixed = C.layer_weights("promotion_accelerator", "emerging_asset")
    assert sum(mixed.values()) == pytest.approx(0.88)


def composite(spark, fit, now=80.0, ahead=80.0, money=80.0, evidence=1.0, available=1.0, emerging=False):
    df = spark.createDataFrame([(fit, now, ahead, money, evidence, available)], "a double, b double, c double, d double, e double, f double")
    return df.select(*(c.alias(n) for n, c in C.Composite(C.layer_weights("low_cost_bridge"), emerging).columns(*map(F.col, "abcdef")).items())).first()


def test_composite(spark):
    w = C.layer_weights("low_cost_bridge")
    total = sum(w.values())
    assert composite(spark, 80.0).composite == pytest.approx(80 * total)
    weak = composite(spark, 39.0, 100.0, 100.0, 100.0, 0.5, 0.8)
    assert weak.capped and weak.composite == pytest.approx(60 * 0.5 * 0.8)
    missing = composite(spark, None, available=None)
    assert missing.fallbacks == ["role_fit", "availability"] and not missing.capped
    assert composite(spark, 80.0, 10.0, 70.0, emerging=True).composite - composite(spark, 80.0, 10.0, 70.0).composite == pytest.approx(20 * w["current"])


def test_risk_tiers(spark):
    df = spark.createDataFrame([(0.85,), (0.65,), (0.45,)], "p double")
    assert [r[0] for r in df.select(C.risk_tier(F.col("p"))).collect()] == ["Low", "Medium", "High"]


CONTEXT = "entity int, status string, value double, wage double, segments array<string>, age double, risk double, confidence_tier string, projection double, height double, label_rows int, label_share double"


def judged(spark, brief, **changes):
    base = {"entity": 1, "status": "green", "value": 10.0, "wage": 1.0, "segments": ["x", None], "age": 25.0, "risk": 0.1, "confidence_tier": "high", "projection": 50.0, "height": 190.0, "label_rows": 9, "label_share": 0.9}
    row = base | changes
    return G.evaluate(spark.createDataFrame([tuple(row[c.split()[0]] for c in CONTEXT.split(", "))], CONTEXT), brief).first()


def results(row):
    return {g.gate: g.result for g in row.gates}


def test_gates(spark):
    brief = G.Brief("x", budget_fee=8.0, age_min=20, age_max=28, pathway_months=6, pathway_age=26, min_height=185, min_share=0.5)
    bad = results(judged(spark, brief, status="red"))
    assert bad["registration"] == bad["affordability"] == bad["pathway"] == "fail" and bad["profile"] == "pass"
    free = G.Brief("x", age_min=20, age_max=28, min_height=185, min_share=0.5, projection_needed=True, wage_band=0.5)
    good = judged(spark, free)
    assert good.passed and good.cautions == ["wage_discipline"] and good.exceptions == []
    assert results(judged(spark, free, age=29.5))["age_band"] == "caution"
    assert results(judged(spark, free, age=None))["age_band"] == "fail"
    assert results(judged(spark, free, height=180.0))["profile"] == "fail"
    assert results(judged(spark, free, label_rows=2))["profile"] == "caution"
    assert not judged(spark, free, segments=["y"]).passed and not judged(spark, free, segments=None).passed
    odd = judged(spark, free, risk=None, confidence_tier=None, projection=None)
    assert odd.passed and {"availability", "confidence"} <= set(odd.cautions) and odd.exceptions == ["projection"]
    both = G.Brief("x", budget_fee=5.0, budget_wage=3.0, contract_years=2)
    assert results(judged(spark, both, value=8.0, wage=1.5))["affordability"] == "pass"
    assert results(judged(spark, both, value=8.0, wage=None))["affordability"] == "fail"


def test_tier_splits(spark):
    t = datetime.datetime
    units = spark.createDataFrame([(1, 1, "a", t(2024, 1, 5), 1.0), (1, 2, "b", t(2024, 1, 6), 2.0), (1, 3, "none", t(2024, 1, 6), 9.0)], "entity int, unit int, cohort string, ts timestamp, m double")
    snaps = spark.createDataFrame([("r", "a", datetime.date(2024, 1, 1), 1), ("r", "b", datetime.date(2024, 1, 1), 12)], "region string, cohort string, day date, position int")
    assert P.tier_splits(units, snaps, "m").first().asDict() == {"entity": 1, "tier1": 1.0, "tier2": None, "tier3": 2.0, "tier4": None}


def test_peer_percentile(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (2, 1, 1.0), (3, 9, 4.0)], "entity int, cohort int, x double").withColumns({"segment": F.lit("s"), "period": F.lit("p")})
    out = {r.entity: r for r in P.peer_percentile(df, "x", 9).collect()}
    assert out[1].percentile == 100.0 and out[1].adjusted == pytest.approx(6.0) and out[2].percentile == 50.0


def test_availability(spark):
    t = datetime.datetime
    rows = [(1, i, t(2024, 1, i + 1), k, v) for i, (k, v) in enumerate([("view", 10.0), ("purchase", 70.0), ("error", 80.0), ("view", 90.0)])] + [(2, 9, t(2024, 1, 1), "view", 5.0)]
    df = spark.createDataFrame(rows, "entity int, unit int, ts timestamp, event_type string, value double")
    out = {r.entity: r for r in P.availability(df, F.lit("2024-01-10").cast("date"), "purchase", "error", "view", 60.0).collect()}
    assert (out[1].units, out[1].starts, out[1].episodes, out[1].days_since, out[1].streak, out[1].rate, out[1].max_gap) == (2, 1, 1, 7, 3, 0.5, 7)
    assert (out[2].episodes, out[2].days_since, out[2].streak, out[2].max_gap, out[2].mean_gap) == (0, None, 0, 0, None)


def test_points(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 12), (2, 1, 0.5, 3), (3, 4, 0.0, 0)], "entity int, level int, share double, caps int")
    assert [(r.points, r.status, r.gaps) for r in P.points_status(df).orderBy("entity").collect()] == [(19, "green", []), (8, "red", ["international"]), (0, "red", ["domestic", "international"])]


def test_validation(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 2, 0.8, 0), ("a", 3, 0.7, 1), ("b", 4, 0.5, 1)], "k string, id int, s double, hit int")
    auc = {r.k: r.auc for r in V.rank_auc(df, ["k"], "s", "hit").collect()}
    assert auc == {"a": 0.5, "b": None}
    assert {r.k: r.precision for r in V.precision_at(df, ["k"], [F.desc("s")], "hit", 2).collect()} == {"a": 0.5, "b": 1.0}
    assert V.resolve_period(spark.createDataFrame([("2022",), ("2024",), ("x",)], "period string"), 2024).first().period == 2022
    assert V.resolve_period(spark.createDataFrame([("2025",)], "period string"), 2024).first().period == 2025
    missing = spark.createDataFrame([(None, 1)], "a int, b int").select(V.unmet({"a": F.col("a") > 0, "b": F.col("b") > 0})).first()[0]
    assert missing == ["a"]
