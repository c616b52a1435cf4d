"""Scalar functions, Column to Column. All run inside the JVM except fold_text() and text_similarity()."""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """value held between low and high; null stays null."""
    return F.when(value.isNull(), None).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def settled(value: Column) -> Column:
    """value to nine digits. Sums of doubles depend on their order in the last bits, so what is held against a threshold is
    settled first."""
    return F.floor(value * 1e9 + 0.5001) / 1e9


@F.pandas_udf(T.StringType())
def fold_text(values: pd.Series) -> pd.Series:
    """HTML entities resolved, compatibility forms taken apart and combining marks dropped."""

    def fold(x):
        if x is None:
            return None
        apart = unicodedata.normalize("NFKD", html.unescape(x))
        return "".join(c for c in apart if not unicodedata.combining(c))

    return values.map(fold, na_action="ignore")


def text_key(value: Column, ascii_only: bool = False) -> Column:
    """Key of a name: folded, lower-cased, '&' spelled out, punctuation to spaces, spaces squeezed."""
    folded = value if ascii_only else fold_text(value)
    spelled = F.regexp_replace(F.lower(folded), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9 ]", " "), " +", " "))


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; 0 if either is missing. For use after a blocking join."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def name_similarity(name_a: Column, name_b: Column, team_a: Column | None = None, team_b: Column | None = None) -> Column:
    """Best of: the plain ratio, the ratio blended with the team's, nine tenths of the token overlap, and .92 where
    one name contains the other."""
    ratio = text_similarity(name_a, name_b)
    tokens_a, tokens_b = F.split(name_a, " "), F.split(name_b, " ")
    overlap = F.size(F.array_intersect(tokens_a, tokens_b)) / F.greatest(F.size(tokens_a), F.size(tokens_b))
    contains = F.when(F.contains(name_a, name_b) | F.contains(name_b, name_a), 0.92).otherwise(0.0)
    parts = [ratio, 0.9 * overlap, contains]
    if team_a is not None:
        parts.append(0.8 * ratio + 0.2 * text_similarity(team_a, team_b))
    return F.greatest(*parts)


def source_similarity(name_a: Column, name_b: Column, team_a: Column | None = None, team_b: Column | None = None) -> Column:
    """The ratio of two name keys, or four fifths of it and a fifth of the teams' where that is more; a missing team on the
    second side counts 0."""
    ratio = text_similarity(name_a, name_b)
    return ratio if team_a is None else F.greatest(ratio, F.when(team_a != "", 0.8 * ratio + 0.2 * text_similarity(team_a, team_b)))


def roster_similarity(name_a: Column, name_b: Column) -> Column:
    """The ratio of two name keys, raised to the strongest of the rules that hold: names in a club's list are short for each
    other, turned round or lack a part."""
    a, b = F.split(name_a, " "), F.split(name_b, " ")
    first = lambda x: F.element_at(x, 1)
    last = lambda x: F.element_at(x, -1)
    long = lambda x: F.filter(x, lambda t: F.length(t) > 1)
    initial = F.substring(name_a, 1, 1) == F.substring(name_b, 1, 1)
    shared = F.arrays_overlap(long(a), long(b))
    same_last, held_last = last(a) == last(b), F.array_contains(b, last(a)) | F.array_contains(a, last(b))
    turned = (F.size(a) >= 2) & (F.size(b) >= 2) & (first(a) == last(b)) & (last(a) == first(b))
    # Scores of the rules.
    rules = [
        (F.sort_array(a) == F.sort_array(b), 0.95), (shared & initial, 0.90), (shared, 0.83), (same_last & initial, 0.90), (same_last, 0.82),
        (~same_last & held_last & initial, 0.89), (~same_last & held_last & ~initial, 0.84), (turned, 0.88),
    ]
    known = (F.coalesce(name_a, F.lit("")) != "") & (F.coalesce(name_b, F.lit("")) != "")
    return F.when(known, F.greatest(text_similarity(name_a, name_b), *(F.when(rule, score) for rule, score in rules))).otherwise(0.0)


def money_to_eur(value: Column, rates: dict[str, float]) -> Column:
    """Amount text such as '£1.2m' as EUR decimal(14,2). A comma is a decimal point; suffixes are bn, m, th and k;
    a currency sign without a rate, and text without a number, give null."""
    text = F.lower(F.trim(F.regexp_replace(value, ",", ".")))
    number = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("decimal(20,6)")
    suffix = F.regexp_extract(text, r"-?\d+(?:\.\d+)?\s*(bn|m|th|k)?\b", 1)
    scale = F.when(suffix == "bn", F.lit(10**9)).when(suffix == "m", F.lit(10**6)).when(suffix.isin("th", "k"), F.lit(10**3)).otherwise(F.lit(1))
    rate = F.lit(None).cast("decimal(10,6)")
    for sign, x in rates.items():
        rate = F.when(F.contains(text, F.lit(sign.lower())), F.lit(str(x)).cast("decimal(10,6)")).otherwise(rate)
    return F.round(number * scale * rate, 2).cast("decimal(14,2)")


def decimal_text(value: Column) -> Column:
    """Decimal text with thousands commas."""
    return F.regexp_replace(value, ",", "").try_cast("decimal(20,4)")


def tolerant_double(value: Column) -> Column:
    """Number text; blanks, 'nan' and anything else are null, a per cent sign is dropped."""
    number = F.trim(F.regexp_replace(value.cast("string"), "%", "")).try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def tolerant_int(value: Column) -> Column:
    """As tolerant_double, cut towards zero."""
    number = tolerant_double(value)
    return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("long")


def tolerant_bool(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "true", "t", "yes"), True).when(text.isin("0", "false", "f", "no"), False)


def clean_text(value: Column) -> Column:
    """Trimmed text; blanks and 'nan' are null."""
    text = F.trim(value)
    return F.when((text == "") | (F.lower(text) == "nan"), None).otherwise(text)


def unit_stripped(value: Column) -> Column:
    """Integer before 'cm' or 'kg'."""
    return tolerant_int(F.regexp_replace(value, "(?i)cm|kg", ""))


def date_of_formats(value: Column, formats: list[str]) -> Column:
    """Date by the first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)).cast("date") for f in formats))


def contract_expiry(value: Column, formats: list[str]) -> Column:
    """A bare year from 2000 to 2100 means its 30 June; other text goes by formats."""
    year = F.when(value.rlike(r"^\d{4}$"), value.try_cast("int"))
    return F.when(year.isNotNull(), F.when(year.between(2000, 2100), F.make_date(year, F.lit(6), F.lit(30)))).otherwise(date_of_formats(value, formats))


def fiscal_year(day: Column, first_month: int = 7) -> Column:
    """Year in which the period that starts in first_month began."""
    return F.year(day) - (F.month(day) < first_month).cast("int")


def timeline_date(value: Column) -> Column:
    """summer_YYYY is 1 July, winter_YYYY and january_YYYY 1 January; else an ISO date."""
    text = F.lower(F.trim(value))
    year = F.regexp_extract(text, r"_(\d{4})$", 1).try_cast("int")
    return (
        F.when(text.rlike(r"^summer_\d{4}$"), F.make_date(year, F.lit(7), F.lit(1)))
        .when(text.rlike(r"^(winter|january)_\d{4}$"), F.make_date(year, F.lit(1), F.lit(1)))
        .otherwise(F.try_to_date(text, "yyyy-MM-dd"))
    )


def period_from_name(name: Column) -> Column:
    """First year of a '24-25' or '24/25' in a file's name as '2024'; null if there is none."""
    found = F.regexp_extract(name, r"(\d{2})\s*[:/-]\s*(\d{2})", 1)
    return F.when(found != "", F.concat(F.lit("20"), found))


def age_years(born: Column, as_of: Column, digits: int = 2) -> Column:
    return F.round(F.datediff(as_of, born) / 365.25, digits)


def prefix_bucket(value: Column, groups: dict[str, str], default: str) -> Column:
    """Group of the longest prefix that value starts with."""
    out = F.lit(default)
    for prefix in sorted(groups, key=lambda p: (len(p), p)):
        out = F.when(F.startswith(value, F.lit(prefix)), F.lit(groups[prefix])).otherwise(out)
    return out


def grid_pair(value: Column) -> tuple[Column, Column]:
    """Row and column of 'row:col'; null for other text."""
    ok = value.rlike(r"^\d+:\d+$")
    return tuple(F.when(ok, F.split(value, ":")[k].try_cast("int")) for k in (0, 1))


def any_of_terms(value: Column, terms: list[str]) -> Column:
    """Whether any of the terms, taken as they stand, is in the lower-cased text."""
    return F.coalesce(F.lower(value).rlike("|".join(rf"\Q{t}\E" for t in terms)), F.lit(False)) if terms else F.lit(False)


def lookup_key(source_id: Column, name: Column, team: Column) -> Column:
    """Key under which a source's record is remembered: its id, else name and team, else name."""
    return (
        F.when(source_id.isNotNull(), F.concat(F.lit("id:"), source_id.cast("string")))
        .when(name.isNotNull() & team.isNotNull(), F.concat(F.lit("name:"), name, F.lit("|team:"), team))
        .when(name.isNotNull(), F.concat(F.lit("name:"), name))
    )


def consistency_score(cv: Column) -> Column:
    """100 / (1 + cv), 50 where cv is missing."""
    return F.coalesce(clamp(F.lit(100.0) / F.nullif(1 + cv, F.lit(0.0))), F.lit(50.0))


def trend_score(slope: Column) -> Column:
    return F.coalesce(clamp(50 + 50 * slope), F.lit(50.0))


def trend_label(slope: Column) -> Column:
    return F.when(slope.isNull() | (F.abs(slope) < 0.02), "stable").when(slope > 0, "rising").otherwise("falling")


def ratio_score(top: Column, base: Column) -> Column:
    """50 * top / base; 50 if either is missing, and 100 or 50 for a base of zero."""
    return F.when(top.isNull() | base.isNull(), 50.0).when(base == 0, F.when(top > 0, 100.0).otherwise(50.0)).otherwise(clamp(50 * top / base))


def calibrated(value: Column, p10: float, p50: float, p90: float, tail: float = 3.0) -> Column:
    """Piecewise linear through (0, 0), (p10, 30), (p50, 50) and (p90, 80), then a saturating tail up to 100."""
    return (
        F.when(value <= 0, 0.0)
        .when(value <= p10, 30 * value / p10)
        .when(value <= p50, 30 + 20 * (value - p10) / (p50 - p10))
        .when(value <= p90, 50 + 30 * (value - p50) / (p90 - p50))
        .otherwise(80 + 20 * (1 - F.exp(-(value - p90) / tail)))
    )


def board_score(value: Column, scale: float = 19.0) -> Column:
    return clamp(100 * (1 - F.exp(-F.greatest(value, F.lit(0.0)) / scale)))


def tier_of(score: Column, tiers: list[tuple[str, float]]) -> Column:
    """Label of the highest threshold that score reaches; null and NaN count as 0."""
    known = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)
    out = F.lit(min(tiers, key=lambda t: t[1])[0])
    for label, least in sorted(tiers, key=lambda t: t[1]):
        out = F.when(known >= least, F.lit(label)).otherwise(out)
    return out


def sample_tier(n: Column) -> Column:
    return F.when(n < 10, "very_low").when(n < 20, "low").when(n < 30, "medium").otherwise("high")


def shrinkage_factor(n: Column, prior: float = 10.0) -> Column:
    return n / (n + prior)


def evidence_multiplier(exposure: Column, full: float = 900.0, floor: float = 0.35) -> Column:
    """Square root of the share of a full sample, at least floor; 1 where exposure is not known."""
    return F.when(exposure.isNull(), 1.0).otherwise(F.greatest(F.lit(floor), F.sqrt(F.least(F.lit(1.0), F.greatest(exposure, F.lit(0.0)) / full))))


def shrink_to(value: Column, mean: Column, factor: Column) -> Column:
    return value * factor + mean * (1 - factor)


def age_curve_score(age: Column, resale: Column, peak: Column, decline: Column, unknown: float = 25.0, floor: float = 5.0) -> Column:
    """100 up to the resale edge, then linearly to 95 at the peak's, 70 at the decline's first and 25 one curve
    step later, 8 less a year after that; at least floor. Unknown ages get unknown."""
    between = lambda a, b, x, y: x + (y - x) * (age - a) / F.nullif(b - a, F.lit(0.0))
    end = decline + 2
    return F.when(age.isNull(), unknown).otherwise(
        F.greatest(
            F.lit(floor),
            F.when(age <= resale, 100.0)
            .when(age <= peak, F.coalesce(between(resale, peak, 100.0, 95.0), F.lit(95.0)))
            .when(age <= decline, F.coalesce(between(peak, decline, 95.0, 70.0), F.lit(70.0)))
            .when(age <= end, between(decline, end, 70.0, 25.0))
            .otherwise(25 - 8 * (age - end)),
        )
    )


def tier_wage(value: Column, tier: Column) -> Column:
    """Yearly wage as a fixed share of value by tier; none for values of 0 or less."""
    share = F.when(tier == 1, F.lit("0.25")).when(tier == 2, F.lit("0.12")).when(tier == 3, F.lit("0.08")).otherwise(F.lit("0.06"))
    return F.when(value > 0, F.round(value * share.cast("decimal(4,2)"), 2))


def floor_cap_estimate(value: Column, ratio: Column, floor: Column, cap: float = 0.40) -> Column:
    """value * ratio, at least floor, and at most cap of value."""
    return F.least(F.greatest(floor, value * ratio), value * cap)


def strength_adjusted(score: Column, factor: Column) -> Column:
    """score * factor to two digits; no score stays none, no factor counts as 1."""
    return F.round(score * F.coalesce(factor, F.lit(1.0)), 2)


def soft_multiplier(evidence: Column) -> Column:
    return 0.55 + 0.45 * evidence


def metric_rate(payload: Column, aliases: list[str], exposure: Column, per: float = 90.0, least: float = 45.0) -> Column:
    """First alias in a map of texts that parses. One ending in per_90 or _90 is a rate already; totals are divided
    by exposure, where that is at least `least`."""
    options = []
    for name in aliases:
        number = tolerant_double(F.try_element_at(payload, F.lit(name)))
        rate = number if name.endswith(("per_90", "_90")) else F.when(exposure >= least, number / (exposure / per))
        options.append(rate)
    return F.coalesce(*options)
