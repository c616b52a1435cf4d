"""Scores: template fits, current performance, projection, value and the composite, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S

LAYERS = ("role_fit", "current", "projection", "financial")

#: Weights of the layers by archetype, in per cent (the tactical share is spread over the others).
ARCHETYPES = {
    "promotion_accelerator": {"tactical": 25, "role_fit": 20, "current": 25, "projection": 5, "financial": 10},
    "championship_transition": {"tactical": 20, "role_fit": 20, "current": 15, "projection": 25, "financial": 15},
    "emerging_asset": {"tactical": 15, "role_fit": 15, "current": 10, "projection": 30, "financial": 25},
    "low_cost_bridge": {"tactical": 15, "role_fit": 20, "current": 25, "projection": 5, "financial": 20},
}


def layer_weights(primary: str, secondary: str | None = None, share: float = 0.70) -> dict[str, float]:
    """Weights of the four layers: primary and secondary blended, the tactical share spread in proportion."""
    a, b = ARCHETYPES[primary], ARCHETYPES[secondary or primary]
    mixed = {k: (share * a[k] + (1 - share) * b[k]) / 100 for k in a}
    rest = sum(mixed[k] for k in LAYERS)
    return {k: mixed[k] * (rest + mixed["tactical"]) / rest for k in LAYERS}


def template_fit(percentiles: DataFrame, template: DataFrame, keys: list[str], factor: str | None = None) -> DataFrame:
    """Sum of weight * percentile over the template's metrics, missing ones counting as 0; shrunk towards 50 by
    factor, if given, and clamped."""
    every = percentiles.select(*keys, *([factor] if factor else [])).distinct().crossJoin(F.broadcast(template))
    joined = every.join(percentiles.select(*keys, "metric", "percentile"), [*keys, "metric"], "left")
    raw = F.sum(F.col("weight") * F.coalesce("percentile", F.lit(0.0)))
    g = joined.groupBy(*keys).agg(raw.alias("raw"), *([F.max(factor).alias("_f")] if factor else []))
    fit = S.shrink_to(F.col("raw"), F.lit(50.0), F.col("_f")) if factor else F.col("raw")
    return g.withColumn("fit", S.clamp(fit)).drop("_f")


def profile_fit(percentiles: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean over the metrics that are there; weights are renormalised only while they sum to under 1."""
    joined = percentiles.join(F.broadcast(weights), "metric").where("percentile IS NOT NULL")
    g = joined.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("percentile")).alias("_s"), F.sum("weight").alias("_w"))
    return g.select(*keys, S.clamp(F.when((F.col("_w") > 0) & (F.col("_w") < 1), F.col("_s") / F.col("_w")).otherwise(F.col("_s"))).alias("fit"))


def current_performance(mean_percentile: Column, cv: Column, slope: Column, top: Column, base: Column) -> Column:
    """.50 level + .20 consistency + .15 trend + .15 against the top tier."""
    return 0.50 * F.coalesce(mean_percentile, F.lit(50.0)) + 0.20 * S.consistency_score(cv) + 0.15 * S.trend_score(slope) + 0.15 * S.ratio_score(top, base)


def financial_score(value: Column) -> Column:
    return S.clamp(50 + 50 * F.coalesce(value, F.lit(0.0)))


@dataclass(frozen=True)
class Composite:
    """Columns of a composite score and what went into it."""

    weights: dict[str, float]
    emerging: bool = False

    def columns(self, role_fit: Column, current: Column, projection: Column, financial: Column, evidence: Column, availability: Column) -> dict[str, Column]:
        """Missing parts count as 50 (availability as 0.75) and are named in fallbacks. A weak fit caps the sum at 60
        before the evidence and availability multipliers. Parts and composite are settled to nine digits."""
        neutral = lambda x: S.settled(F.coalesce(x, F.lit(50.0)))
        fit, now, ahead, money = map(neutral, (role_fit, current, projection, financial))
        counted = F.when(F.lit(self.emerging) & (ahead >= 70), F.greatest(F.lit(30.0), now)).otherwise(now)
        w = self.weights
        raw = fit * w["role_fit"] + counted * w["current"] + ahead * w["projection"] + money * w["financial"]
        capped = F.when(fit < 40, F.least(raw, F.lit(60.0))).otherwise(raw)
        missing = {"role_fit": role_fit, "current": current, "projection": projection, "financial": financial, "availability": availability}
        return {
            "composite": S.settled(capped * F.coalesce(evidence, F.lit(1.0)) * F.coalesce(availability, F.lit(0.75))),
            "capped": fit < 40,
            "fallbacks": F.array_compact(F.array(*(F.when(x.isNull(), F.lit(k)) for k, x in missing.items()))),
        }


def heuristic_projection(rate: Column, multiplier: Column) -> dict[str, Column]:
    """Band around rate * multiplier: a quarter either side, at least .05, never below 0."""
    mid = rate * multiplier
    spread = F.greatest(F.lit(0.05), 0.25 * mid)
    return {"p10": F.greatest(F.lit(0.0), mid - spread), "p50": mid, "p90": mid + spread}


def starter_probability(start_rate: Column, mean_exposure: Column) -> Column:
    return S.clamp(0.45 * start_rate + 0.55 * F.least(mean_exposure / 90, F.lit(1.0)), 0.2, 0.92)


def value_bands(value: Column, age: Column, trend: Column, quality: Column, cost: Column) -> dict[str, Column]:
    """Band of 15 per cent, resale by age and trend, and value against cost from -1 to 1."""
    resale = value * F.when(age < 23, 1.25).when(age < 27, 1.1).when(age < 30, 0.9).otherwise(0.6) * F.when(trend > 0, 1.1).when(trend < 0, 0.9).otherwise(1.0)
    ratio = (0.6 * value + 0.4 * resale) / F.nullif(cost, F.lit(0.0)) - 1
    return {"low": 0.85 * value, "mid": value, "high": 1.15 * value, "resale": resale, "value_ratio": S.clamp(0.7 * ratio + 0.3 * (quality - 50) / 50, -1.0, 1.0)}


def availability_probability(rate: Column, frequency: Column, repeat: Column, longest: Column, continuity: Column, days_since: Column) -> Column:
    """Chance to be available, from history: a linear rule clipped to [.2, .95]."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    rest = F.when(zero(days_since) > 365, 0.05).otherwise(0.0)
    score = 0.52 + 0.38 * F.coalesce(rate, F.lit(0.5)) - 0.035 * zero(frequency) - 0.14 * zero(repeat) - 0.0015 * zero(longest) + 0.018 * F.least(zero(continuity), F.lit(10)) + rest
    return S.clamp(score, 0.2, 0.95)


def risk_tier(available: Column) -> Column:
    risk = S.settled(1 - available)
    return F.when(risk > 0.40, "High").when(risk > 0.20, "Medium").otherwise("Low")
