"""Feature plans: one DataFrame of units in, one row per entity (and period) out, for all entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.operators import aggregates as A
from cohortrank.operators import joins as J
from cohortrank.operators import windows as N


def confidence(units: DataFrame, keys: list[str] = ("entity", "period"), low: float = 500.0) -> DataFrame:
    """Sample size of each key over units with exposure, its tier, shrinkage and evidence multiplier."""
    g = units.where("exposure > 0").groupBy(*keys).agg(F.sum("exposure").alias("total"), F.count("*").alias("n"))
    return g.withColumns({"tier": S.sample_tier(F.col("n")), "shrinkage": S.shrinkage_factor(F.col("n")), "evidence": S.evidence_multiplier(F.col("total")), "limited": F.col("total") < low})


def points_status(df: DataFrame) -> DataFrame:
    """Registration points from level, share of starts and caps; 15 or more are green, 10 or more amber."""
    level, share = F.col("level"), F.col("share")
    domestic = (
        F.when((level == 1) & (share >= 0.8), 12).when((level == 1) & (share >= 0.4), 8).when((level == 2) & (share >= 0.4), 6).when(share >= 0.2, 3).otherwise(0)
    )
    caps = F.when(F.col("caps") >= 12, 7).when(F.col("caps") >= 6, 4).otherwise(0)
    points = domestic + caps
    gaps = F.array_compact(F.array(F.when(domestic == 0, F.lit("domestic")), F.when(caps == 0, F.lit("international"))))
    out = df.withColumns({"points": points, "gaps": gaps})
    return out.withColumn("status", F.when(F.col("points") >= 15, "green").when(F.col("points") >= 10, "amber").otherwise("red"))


def peer_percentile(rates: DataFrame, value: str, reference_cohort) -> DataFrame:
    """Percentile among peers of cohort, segment and period, and value scaled from its peers' mean to that of the
    reference cohort's peers (its own peers where those are missing); null where the peers' mean is 0."""
    peers = ["cohort", "segment", "period"]
    means = rates.groupBy(*peers).agg(F.avg(value).alias("_peer"))
    reference = means.where(F.col("cohort") == reference_cohort).select("segment", "period", F.col("_peer").alias("_ref"))
    out = N.member_percentile(rates, peers, value).join(means, peers).join(reference, ["segment", "period"], "left")
    adjusted = F.when(F.col("_peer") != 0, F.col(value) / F.col("_peer") * F.coalesce("_ref", "_peer"))
    return out.withColumn("adjusted", adjusted).drop("_peer", "_ref")


def tier_splits(units: DataFrame, snapshots: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric by the tier that its cohort had at the time: quarters of the snapshot's size, fewer than
    four ranked counting as twenty."""
    size = snapshots.groupBy("region", "day").agg(F.count("*").alias("size"))
    ranked = snapshots.join(size, ["region", "day"]).select("cohort", "day", "position", "size")
    placed = J.asof_join(units.withColumn("_day", F.to_date("ts")), ranked, ["cohort"], "_day", "day", ["position", "size"], span=lambda t: F.date_trunc("month", t))
    quarter = F.greatest(F.lit(1), F.floor(F.when(F.col("size") < 4, 20).otherwise(F.col("size")) / 4))
    tier = F.when(F.col("position").isNotNull(), F.least(F.lit(4), F.ceil(F.col("position") / quarter)))
    return placed.withColumn("tier", F.concat(F.lit("tier"), tier.cast("int").cast("string"))).groupBy("entity").pivot("tier", [f"tier{k}" for k in range(1, 5)]).agg(F.avg(metric))


def availability(events: DataFrame, as_of: Column, start: str, episode: str, unit: str, streak_at: float, window_days: int = 1095) -> DataFrame:
    """Per entity: share of units started, episodes in the window and their spacing, share that repeats a label,
    days since the last, and the trailing streak of units at streak_at or above. Entities without episodes get
    zeros and nulls."""
    kind = F.col("event_type")
    day = F.to_date("ts")
    inside = (kind == episode) & (day.isNull() | (F.datediff(as_of, day) <= window_days))
    base = events.groupBy("entity").agg(
        F.count_if(kind == unit).alias("units"), F.count_if(kind == start).alias("starts"), F.count_if(inside).alias("episodes"),
        F.datediff(as_of, F.max(F.when(kind == episode, day))).alias("days_since"),
    )
    episodes = events.where(kind == episode).withColumn("day", day)
    episodes = episodes.withColumn("next", F.lead("day").over(W.partitionBy("entity").orderBy("ts", "unit")))
    spans = episodes.withColumn("days", A.duration_days(F.col("day"), F.col("next"), as_of)).groupBy("entity").agg(F.avg("days").alias("mean_gap"), F.max("days").alias("max_gap"))
    streak = N.trailing_streak(events, ["entity"], [F.desc("ts"), F.desc("unit")], F.col("value") >= streak_at)
    out = base.join(spans, "entity", "left").join(A.repeat_share(events, ["entity"], "event_type"), "entity", "left").join(streak, "entity", "left")
    return out.withColumns({"rate": F.when(F.col("units") > 0, F.least(F.lit(1.0), F.col("starts") / F.col("units"))), "max_gap": F.coalesce("max_gap", F.lit(0)), "streak": F.coalesce("streak", F.lit(0))})


def trajectory(units: DataFrame, as_of: Column) -> DataFrame:
    """Per entity: periods and labels seen, years since the first unit, slope of the yearly mean and the
    periods in a row at the latest label."""
    years = units.groupBy("entity", "period").agg(F.avg("m1").alias("mean"), F.max("label").alias("label"))
    base = units.groupBy("entity").agg(F.count_distinct("period").alias("periods"), F.count_distinct("label").alias("labels"), F.min("ts").alias("_first"))
    slope = years.groupBy("entity").agg(F.regr_slope("mean", F.col("period").cast("double")).alias("slope"), F.count("*").alias("_n"))
    latest = years.withColumn("_last", F.first("label").over(W.partitionBy("entity").orderBy(F.desc("period"))))
    stay = N.trailing_streak(latest, ["entity"], [F.desc("period")], F.col("label") == F.col("_last")).withColumnRenamed("streak", "periods_at_label")
    out = base.join(slope, "entity").join(stay, "entity")
    return out.select("entity", "periods", "labels", S.age_years(F.to_date("_first"), as_of).alias("age"), F.when(F.col("_n") >= 2, F.col("slope")).alias("slope"), "periods_at_label")


def recent_vs_all(units: DataFrame, metrics: list[str], last: int = 5) -> DataFrame:
    """Per entity and metric: mean of the last units, of all, their maximum and the ratio of the two means."""
    long = N.to_long(units, ["entity", "unit", "ts"], metrics)
    ranked = long.withColumn("_n", F.row_number().over(W.partitionBy("entity", "metric").orderBy(F.desc("ts"), F.desc("unit"))))
    g = ranked.groupBy("entity", "metric").agg(F.avg(F.when(F.col("_n") <= last, F.col("value"))).alias("recent"), F.avg("value").alias("overall"), F.max("value").alias("top"))
    return g.withColumn("ratio", F.col("recent") / F.nullif("overall", F.lit(0.0)))


def grid_share(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of central and wide cells: rows up to 3; central means inner cells of rows up to 2 that are 3 or more
    wide, wide the edges."""
    width = F.max("col").over(W.partitionBy(*keys, "unit", "row"))
    seen = cells.where("row <= 3").withColumn("width", width)
    edge = (F.col("col") == 1) | (F.col("col") == F.col("width"))
    central = (F.col("row") <= 2) & (F.col("width") >= 3) & ~edge
    return seen.groupBy(*keys).agg(F.count("*").alias("cells"), F.avg(central.cast("int")).alias("central_share"), F.avg(edge.cast("int")).alias("wide_share"))


def forward_target(units: DataFrame, started: Column, least: float = 0.75) -> DataFrame:
    """Per entity and period: share started now, and whether the next period's reaches `least`."""
    g = units.groupBy("entity", "period").agg(F.avg(started.cast("int")).alias("share"), F.count("*").alias("n"))
    return J.period_transition(g, "entity", ["period"], ["share", "period"]).withColumn("target", (F.col("next_share") >= least).cast("int"))


def value_rows(units: DataFrame, current: DataFrame, levels: DataFrame, as_of: Column, metrics: list[str]) -> DataFrame:
    """One row per entity for the value model: age, first letter of the latest label, level of its cohort, contract
    years, latest value, mean of its rates and slope of its yearly mean.

    current: entity, born, cohort, contract_end, value. The level (levels: cohort, level) is that of the cohort of
    most units (ties to the smaller), else of the current one, else 3.
    """
    latest = units.groupBy("entity").agg(F.upper(F.substring(F.max_by("label", F.struct("ts", "unit")), 1, 1)).alias("position_group"))
    most = units.where("cohort IS NOT NULL").groupBy("entity", "cohort").agg(F.count("*").alias("_n"))
    modal = J.latest_per_key(most, ["entity"], [F.desc("_n"), "cohort"]).select("entity", F.col("cohort").alias("_modal"))
    rates = A.per_exposure(units, metrics).groupBy("entity").agg(*(F.avg(f"{m}_rate").alias(f"_{m}") for m in metrics))
    slope = trajectory(units, as_of).select("entity", F.coalesce("slope", F.lit(0.0)).alias("trajectory"))
    tier = lambda c, name: levels.select(F.col("cohort").alias(c), F.col("level").cast("double").alias(name))
    j = current.withColumnRenamed("cohort", "_current").join(latest, "entity", "left").join(modal, "entity", "left").join(rates, "entity", "left").join(slope, "entity", "left")
    j = j.join(tier("_modal", "_a"), "_modal", "left").join(tier("_current", "_b"), "_current", "left")
    known = [F.col(f"_{m}") for m in metrics]
    count = sum((x.isNotNull().cast("int") for x in known), F.lit(0))
    mean = F.when(count > 0, sum((F.coalesce(x, F.lit(0.0)) for x in known), F.lit(0.0)) / count)
    years = F.greatest(F.lit(0.0), F.round(F.datediff(F.col("contract_end"), as_of) / 365.25, 2))
    return j.select(
        "entity", S.age_years(F.col("born"), as_of).alias("age"), F.coalesce("position_group", F.lit("U")).alias("position_group"), F.coalesce("_a", "_b", F.lit(3.0)).alias("level"), F.coalesce(years, F.lit(0.0)).alias("contract_years"),
        F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.coalesce(mean, F.lit(0.0)).alias("rate"), F.coalesce("trajectory", F.lit(0.0)).alias("trajectory"),
    )


#: Nationalities that need no registration.
EXEMPT = ["england", "scotland", "wales", "northern ireland", "ireland", "republic of ireland"]


def registration(df: DataFrame, exempt: list[str] = EXEMPT) -> DataFrame:
    """Registration points from nationality, level, starts, appearances, continental and international matches; a null
    count was not tracked. Adds points, gaps and status: 15 or more are green, 10 or more amber. The exempt have 15;
    without appearances or a level's unit there are none."""
    share = F.when(F.col("appearances") > 0, F.col("starts") / F.col("appearances")).otherwise(0.0)
    level = F.coalesce(F.col("level"), F.lit(5))
    # Points by level and share of starts, by continental and by international matches.
    domestic = (
        F.when(level <= 1, F.when(share >= 0.7, 10).otherwise(8)).when(level == 2, F.when(share >= 0.7, 8).otherwise(6)).when(level == 3, F.when(share >= 0.7, 4).otherwise(2))
        .when(level == 4, F.when(share >= 0.5, 2).otherwise(1)).otherwise(0)
    )
    abroad = F.when(F.col("continental") >= 10, 5).when(F.col("continental") > 0, 3).otherwise(0)
    caps = F.when(F.col("international") >= 10, 5).when(F.col("international") >= 3, 3).when(F.col("international") > 0, 1).otherwise(0)
    free = F.coalesce(F.lower(F.trim("nationality")).isin(exempt), F.lit(False))
    seen = F.coalesce(F.col("appearances") > 0, F.lit(False))
    points = F.when(free, 15).when(seen, domestic + abroad + caps).otherwise(0)
    untracked = F.array_compact(F.array(F.when(F.col("continental").isNull(), F.lit("continental")), F.when(F.col("international").isNull(), F.lit("international"))))
    gaps = F.when(free, F.array().cast("array<string>")).when(~seen, F.array(F.lit("appearances"))).otherwise(untracked)
    out = df.withColumns({"points": points, "gaps": gaps})
    return out.withColumn("status", F.when(F.col("points") >= 15, "green").when(F.col("points") >= 10, "amber").otherwise("red"))
