import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S


def one(spark, column, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("y")).first().y


@pytest.mark.parametrize(("text", "key"), [("Málaga C.F.", "malaga c f"), ("C. O&apos;Riordan", "c o riordan"), ("Tom &amp; Co", "tom and co"), ("  A--B ", "a b"), (None, None), ("", "")])
def test_text_key(spark, text, key):
    assert one(spark, S.text_key(F.col("x")), text) == key


@pytest.mark.parametrize(("text", "eur"), [("£1.2m", "1404000.00"), ("€750k", "750000.00"), ("€ 1,5 bn", "1500000000.00"), ("300th €", "300000.00"), ("€-12.5", "-12.50"), ("-", None), ("$5", None), (None, None)])
def test_money(spark, text, eur):
    assert one(spark, S.money_to_eur(F.col("x"), {"£": 1.17, "€": 1.0}), text) == (eur and Decimal(eur))


@pytest.mark.parametrize(("text", "number"), [("78%", 78.0), (" 7.5 ", 7.5), ("", None), ("nan", None), ("x", None), (None, None)])
def test_tolerant_numbers(spark, text, number):
    assert one(spark, S.tolerant_double(F.col("x")), text) == number


def test_tolerant_others(spark):
    assert one(spark, S.tolerant_int(F.col("x")), "-3.9") == -3 and one(spark, S.tolerant_int(F.col("x")), "3.9") == 3
    assert one(spark, S.tolerant_bool(F.col("x")), " Yes ") is True and one(spark, S.tolerant_bool(F.col("x")), "maybe") is None
    assert one(spark, S.clean_text(F.col("x")), " NaN ") is None and one(spark, S.unit_stripped(F.col("x")), "187 cm") == 187
    assert one(spark, S.decimal_text(F.col("x")), "1,234.5") == Decimal("1234.5000")


def test_dates(spark):
    day = datetime.date
    formats = ["yyyy-MM-dd", "MMM d, yyyy", "dd/MM/yyyy"]
    assert one(spark, S.date_of_formats(F.col("x"), formats), "Jun 3, 2024") == day(2024, 6, 3)
    assert one(spark, S.date_of_formats(F.col("x"), formats), "rubbish") is None
    assert one(spark, S.contract_expiry(F.col("x"), formats), "2027") == day(2027, 6, 30)
    assert one(spark, S.contract_expiry(F.col("x"), formats), "1987") is None
    assert one(spark, S.timeline_date(F.col("x")), "summer_2026") == day(2026, 7, 1)
    assert one(spark, S.timeline_date(F.col("x")), "january_2026") == day(2026, 1, 1)
    assert one(spark, S.timeline_date(F.col("x")), "2026-03-04") == day(2026, 3, 4)
    assert one(spark, S.fiscal_year(F.col("x").cast("date")), "2024-06-30") == 2023
    assert one(spark, S.period_from_name(F.col("x")), "League 24-25.csv") == "2024"
    assert one(spark, S.period_from_name(F.col("x")), "League.csv") is None


def test_labels(spark):
    groups = {"C": "D", "CM": "M", "CF": "F"}
    assert [one(spark, S.prefix_bucket(F.col("x"), groups, "?"), x) for x in ("CB", "CM", "CF", "G")] == ["D", "M", "F", "?"]
    row, col = S.grid_pair(F.col("x"))
    assert one(spark, row, "2:11") == 2 and one(spark, col, "2:11") == 11 and one(spark, row, "2-1") is None
    assert one(spark, S.any_of_terms(F.col("x"), ["hamstring", "muscle"]), "Muscle tear") is True
    assert one(spark, S.any_of_terms(F.col("x"), ["hamstring"]), None) is False
    null = F.lit(None).cast("string")
    assert one(spark, S.lookup_key(F.col("x"), F.lit("n"), F.lit("t")), "7") == "id:7"
    assert one(spark, S.lookup_key(F.col("x"), F.lit("n"), F.lit("t"))) == "name:n|team:t"
    assert one(spark, S.lookup_key(F.col("x"), F.lit("n"), null)) == "name:n" and one(spark, S.lookup_key(F.col("x"), null, null)) is None


def number(spark, column, value):
    return one(spark, column, value, "x double")


def test_scores(spark):
    x = F.col("x")
    assert number(spark, S.shrinkage_factor(x), 18.0) == pytest.approx(18 / 28)
    assert number(spark, S.evidence_multiplier(x), 400.0) == pytest.approx((400 / 900) ** 0.5)
    assert number(spark, S.evidence_multiplier(x), None) == 1.0 and number(spark, S.evidence_multiplier(x), 0.0) == 0.35
    assert [number(spark, S.calibrated(x, 2.7, 3.88, 6.29), v) for v in (0.0, 2.7, 3.88, 6.29)] == pytest.approx([0, 30, 50, 80])
    assert 80 < number(spark, S.calibrated(x, 2.7, 3.88, 6.29), 9.0) < 100
    assert number(spark, S.clamp(x), None) is None and number(spark, S.clamp(x), 140.0) == 100
    tiers = [("a", 40.0), ("b", 20.0), ("c", 0.0)]
    assert [number(spark, S.tier_of(x, tiers), v) for v in (40.0, 39.9, None, float("nan"))] == ["a", "b", "c", "c"]
    assert [number(spark, S.trend_label(x), v) for v in (0.01, 0.5, -0.5, None)] == ["stable", "rising", "falling", "stable"]
    assert number(spark, S.ratio_score(x, F.lit(0.0)), 1.0) == 100 and number(spark, S.ratio_score(x, F.lit(2.0)), None) == 50
    assert number(spark, S.strength_adjusted(x, F.lit(0.913)), 57.48547717842324) == 52.48
    curve = [number(spark, S.age_curve_score(x, F.lit(22.0), F.lit(26.0), F.lit(30.0)), v) for v in (20.0, 22.0, 26.0, 30.0, 32.0, 33.0, 60.0, None)]
    assert curve == pytest.approx([100, 100, 95, 70, 25, 17, 5, 25])


def test_metric_rate(spark):
    payload = F.create_map(F.lit("shots_per_90"), F.lit("x"), F.lit("shots"), F.lit("4"))
    assert one(spark, S.metric_rate(payload, ["shots_per_90", "shots"], F.lit(180.0))) == 2.0
    assert one(spark, S.metric_rate(payload, ["shots"], F.lit(30.0))) is None


def test_similarity(spark):
    a, b = F.lit("c rushworth"), F.lit("carl rushworth")
    assert one(spark, S.name_similarity(a, b)) >= 0.80
    assert one(spark, S.name_similarity(F.lit("rushworth"), b)) >= 0.92
    assert one(spark, S.text_similarity(F.lit("abc"), F.col("x"))) == 0.0
