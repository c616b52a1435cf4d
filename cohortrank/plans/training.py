"""Training rows of the projection and value models, each as of its reference day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.operators import joins as J

#: Least exposure before and after a change of cohort, the place of a team without one, the age where it is
#: not known, and the share of starts that makes a starter.
LEAST_BEFORE, LEAST_AFTER, UNPLACED, UNKNOWN_AGE, STARTER = 540, 450, 12, 24.0, 0.75


def projection_rows(matches: DataFrame, places: DataFrame, roles: DataFrame, born: DataFrame, metrics: list[str], before: float = LEAST_BEFORE, after: float = LEAST_AFTER, per: float = 90.0) -> DataFrame:
    """One row for each change of cohort between an entity's consecutive periods with enough exposure.

    matches: entity, period, cohort, team, exposure, substitute and metrics. places: cohort, team, day, position. roles:
    entity, day, role. born: entity, born. The reference day is the first of the later period; places, roles and age are
    those of that day, so nothing later enters. Rates of both periods, and starter: the share of starts in the later one
    reaches 75 %.
    """
    starts = F.count_if(~F.coalesce("substitute", F.lit(False)))
    sums = [F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in metrics]
    g = matches.groupBy("entity", "period", "cohort").agg(F.sum(F.coalesce("exposure", F.lit(0))).alias("exposure"), F.count("*").alias("n"), starts.alias("starts"), F.max("team").alias("team"), *sums).where(F.col("exposure") >= before)
    over = W.partitionBy("entity").orderBy("period", "cohort")
    later = F.lead(F.struct(*(c for c in g.columns if c != "entity"))).over(over)
    moved = g.withColumn("to", later).where((F.col("to.cohort") != F.col("cohort")) & (F.col("to.exposure") >= after))
    rate = lambda side, m: F.col(f"{side}{m}") / F.greatest(F.col(f"{side}exposure"), F.lit(1)) * per
    rows = moved.select(
        "entity", "period", F.col("to.period").alias("next_period"), "cohort", F.col("to.cohort").alias("next_cohort"), "team", F.col("to.team").alias("next_team"),
        F.make_date(F.substring("to.period", 1, 4).cast("int"), F.lit(1), F.lit(1)).alias("ref"), *(rate("", m).alias(f"origin_{m}") for m in metrics), *(rate("to.", m).alias(f"target_{m}") for m in metrics),
        (F.col("to.starts") / F.col("to.n") >= STARTER).cast("int").alias("target_starter"),
    )
    placed = places.select("cohort", "team", "day", "position")
    key = ["entity", "period", "cohort"]
    seen = J.asof_many(rows, key, "ref", {
        "_from": (placed, ["cohort", "team"], ["cohort", "team"], "day"), "_to": (placed, ["next_cohort", "next_team"], ["cohort", "team"], "day"), "_role": (roles.select("entity", "day", "role"), ["entity"], ["entity"], "day"),
    }).join(born, "entity", "left")
    place = lambda c: F.coalesce(F.col(f"{c}.position").cast("double"), F.lit(float(UNPLACED)))
    return seen.select(
        "entity", "period", "next_period", "cohort", "next_cohort", F.coalesce(S.age_years(F.col("born"), F.col("ref"), 1), F.lit(UNKNOWN_AGE)).alias("age"), F.coalesce("_role.role", F.lit("unknown")).alias("role"),
        place("_from").alias("origin_position"), place("_to").alias("target_position"), *(f"origin_{m}" for m in metrics), *(f"target_{m}" for m in metrics), "target_starter",
    )


def fee_rows(signings: DataFrame, values: DataFrame, seasons: DataFrame, roles: DataFrame, levels: DataFrame, born: DataFrame, weights: dict[str, float], per: float = 90.0) -> DataFrame:
    """One row for each signing with a fee above 0: age, position letter, role, cohort level (3 where not known), years of
    contract left, value and weighted output, all as of the day it was signed.

    signings: signing, entity, day, fee. values: entity, day, value, contract_end. seasons: entity, day (its last), cohort,
    label, exposure and metrics. roles: entity, day, role. levels: cohort, level.
    """
    rows = signings.where("fee > 0 AND day IS NOT NULL")
    seen = J.asof_many(rows, ["signing"], "day", {
        "_value": (values.select("entity", "day", "value", "contract_end"), ["entity"], ["entity"], "day"), "_season": (seasons.select("entity", "day", "cohort", "label", "exposure", *weights), ["entity"], ["entity"], "day"),
        "_role": (roles.select("entity", "day", "role"), ["entity"], ["entity"], "day"),
    }).join(born, "entity", "left").withColumn("_cohort", F.col("_season.cohort"))
    seen = seen.join(levels.select(F.col("cohort").alias("_cohort"), F.col("level").cast("double").alias("_level")), "_cohort", "left")
    whole = F.greatest(F.coalesce(F.col("_season.exposure").cast("double"), F.lit(0.0)), F.lit(1.0))
    output = sum((F.coalesce(F.col(f"_season.{m}").cast("double"), F.lit(0.0)) / whole * per * w for m, w in weights.items()), F.lit(0.0))
    left = F.greatest(F.lit(0.0), F.datediff(F.col("_value.contract_end"), F.col("day")) / 365.25)
    return seen.select(
        "signing", "entity", F.coalesce(S.age_years(F.col("born"), F.col("day"), 1), F.lit(UNKNOWN_AGE)).alias("age"), F.coalesce(F.upper(F.substring("_season.label", 1, 1)), F.lit("U")).alias("position_group"),
        F.coalesce("_role.role", F.lit("unknown")).alias("role"), F.coalesce("_level", F.lit(3.0)).alias("level"), F.coalesce(left, F.lit(0.0)).alias("contract_years"),
        F.coalesce(F.col("_value.value").cast("double"), F.lit(0.0)).alias("value"), output.alias("output"), "fee",
    )
