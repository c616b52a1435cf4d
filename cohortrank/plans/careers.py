"""Careers: stints at teams, the tiers, countries and teams of a career, its last trend, and the place on the age curve.

matches: entity, period, ts, cohort, team, position, exposure and metrics. transfers: entity, kind, team_in, team_out.
entities: entity, born, team. leagues: cohort, tier, country.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.operators import aggregates as A
from cohortrank.operators import windows as N


def periods(matches: DataFrame, metrics: list[str]) -> DataFrame:
    """Per entity and period, over units with exposure: most frequent cohort and team, and the mean rate of each metric."""
    rated = A.per_exposure(matches, metrics)
    key = ["entity", "period"]
    means = rated.groupBy(*key).agg(*(F.avg(f"{m}_rate").alias(m) for m in metrics))
    return means.join(A.modal(rated, key, "cohort"), key, "left").join(A.modal(rated, key, "team"), key, "left")


def stints(seasons: DataFrame) -> DataFrame:
    """Runs of an entity's consecutive periods at one team: entity, team, first, last and n periods. A period without a team
    ends a run; a run is what keeps the difference of two row numbers."""
    every = F.row_number().over(W.partitionBy("entity").orderBy("period"))
    within = F.row_number().over(W.partitionBy("entity", "team").orderBy("period"))
    island = seasons.withColumn("_island", every - within).where("team IS NOT NULL")
    return island.groupBy("entity", "team", "_island").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count("*").alias("n")).drop("_island")


def curve_position(label: Column, age: Column, groups: dict[str, str], curves: dict[str, tuple[float, float]]) -> Column:
    """pre_peak, peak or post_peak by the curve (first year of the peak, first of the decline) of the first group whose token
    is in the lower-cased label; null without one or without an age."""
    group = F.lit(None).cast("string")
    for token, name in reversed(list(groups.items())):
        group = F.when(F.contains(F.lower(F.trim(label)), F.lit(token)), name).otherwise(group)
    at = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for g, c in curves.items() for x in (g, float(c[i])))), group)
    return F.when(age.isNotNull() & at(0).isNotNull(), F.when(age < at(0), "pre_peak").when(age >= at(1), "post_peak").otherwise("peak"))


def features(matches: DataFrame, transfers: DataFrame, entities: DataFrame, leagues: DataFrame, metrics: list[str], as_of: Column, groups: dict[str, str], curves: dict[str, tuple[float, float]]) -> DataFrame:
    """One row for each entity with matches: tiers by period in order, loans, teams, countries, age at the first unit, periods
    in a row up to the last at the current team, mean change of the metrics over the last two periods (those that both
    have), and the place on the age curve of its most frequent position."""
    seasons = periods(matches, metrics).join(leagues, "cohort", "left")
    step = F.array_sort(F.collect_list(F.struct("period", "tier")))
    history = seasons.groupBy("entity").agg(step.alias("tier_history"), F.count_distinct("country").alias("countries"))
    last = N.top_per_group(seasons, ["entity"], [F.desc("period")], 2)
    pick = lambda m, k: F.max(F.when(F.col("place") == k, F.col(m)))
    changes = last.groupBy("entity").agg(F.array_compact(F.array(*(pick(m, 1) - pick(m, 2) for m in metrics))).alias("_steps"))
    trend = changes.select("entity", F.when(F.size("_steps") > 0, F.aggregate("_steps", F.lit(0.0), lambda s, x: s + x) / F.size("_steps")).alias("change"))
    stay = N.trailing_streak(seasons.join(entities.select("entity", F.col("team").alias("_now")), "entity", "left"), ["entity"], [F.desc("period")], F.col("team") == F.col("_now")).withColumnRenamed("streak", "periods_at_team")
    loans = transfers.groupBy("entity").agg(F.count_if(F.contains(F.lower("kind"), F.lit("loan"))).alias("loans"))
    named = lambda df, c: df.select("entity", F.col(c).alias("_team")).where("_team <> ''")
    known = named(transfers, "team_in").unionByName(named(transfers, "team_out")).unionByName(named(entities, "team"))
    teams = known.groupBy("entity").agg(F.count_distinct("_team").alias("teams"))
    first = matches.groupBy("entity").agg(F.to_date(F.min("ts")).alias("_first")).join(A.modal(matches.where("trim(position) <> ''").withColumn("_label", F.lower(F.trim("position"))), ["entity"], "_label"), "entity", "left")
    out = first.join(entities.select("entity", "born"), "entity", "left")
    for part in (history, trend, stay, loans, teams):
        out = out.join(part, "entity", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "entity", "tier_history", zero("loans"), zero("teams"), zero("countries"), S.age_years(F.col("born"), F.col("_first")).alias("age_first"), zero("periods_at_team"), "change",
        curve_position(F.col("_label"), S.age_years(F.col("born"), as_of), groups, curves).alias("curve"),
    )
