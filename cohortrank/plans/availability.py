"""Availability from matches, a schedule and absence spans: features of all entities as of a day, units missed in spans, and
training rows as of the end of each period.

matches: entity, unit, period, ts, team, exposure, substitute. schedule: unit, period, team, day, a row for each side of a
unit. spans: entity, kind, start_day, end_day, either end may be open. absences: entity, day. changes: entity, unit,
event, elapsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.operators import aggregates as A
from cohortrank.operators import joins as J
from cohortrank.operators import windows as N

#: What marks a muscle problem.
MUSCLE = ["muscle", "hamstring", "thigh", "calf", "groin"]
#: Days that count as recent, and the minute before which a starter counts as taken off.
RECENT_DAYS, TAKEN_OFF = 1095, 80


def period_rates(matches: DataFrame, schedule: DataFrame) -> DataFrame:
    """Per entity and period: its most frequent team, starts, units of that team (its own units where the schedule lacks the
    team), their ratio, and _first, the time of its first unit."""
    team = A.modal(matches, ["entity", "period"], "team")
    units = schedule.groupBy("team", "period").agg(F.count_distinct("unit").alias("_team_units"))
    starts = F.count_if(~F.coalesce("substitute", F.lit(False)))
    own = matches.groupBy("entity", "period").agg(starts.alias("starts"), F.count_distinct("unit").alias("_own_units"), F.min("ts").alias("_first"))
    j = own.join(team, ["entity", "period"], "left").join(units, ["team", "period"], "left").withColumn("units", F.coalesce("_team_units", "_own_units"))
    return j.select("entity", "period", "team", "starts", "units", (F.col("starts") / F.nullif("units", F.lit(0))).alias("rate"), "_first")


def span_summary(spans: DataFrame, keys: list[str], ref: Column, muscle: list[str] = MUSCLE) -> DataFrame:
    """Per key: episodes, mean and longest duration, muscle episodes, share of episodes that repeat a label, last end.

    An open end lasts to ref, an open start makes a duration of 0; blank labels count as episodes but not as labels.
    Episodes are added up by label first, so a key with many of them is no single group.
    """
    days = A.duration_days(F.col("start_day"), F.col("end_day"), ref)
    label = F.nullif(F.lower(F.trim("kind")), F.lit(""))
    by_label = spans.withColumns({"_label": label, "_days": days, "_m": S.any_of_terms(F.col("kind"), muscle).cast("int")}).groupBy(*keys, "_label").agg(
        F.count("*").alias("_n"), F.sum("_days").alias("_d"), F.max("_days").alias("_top"), F.sum("_m").alias("_m"), F.max("end_day").alias("_end")
    )
    named = F.when(F.col("_label").isNotNull(), F.col("_n"))
    return by_label.groupBy(*keys).agg(
        F.sum("_n").alias("episodes"), (F.sum("_d") / F.sum("_n")).alias("mean_days"), F.max("_top").alias("max_days"), F.sum("_m").alias("muscle"),
        (F.sum(named - 1) / F.nullif(F.sum(named), F.lit(0))).alias("repeat_share"), F.max("_end").alias("_last_end"),
    )


def features(matches: DataFrame, schedule: DataFrame, spans: DataFrame, absences: DataFrame, changes: DataFrame, as_of: Column, recent: int = RECENT_DAYS) -> DataFrame:
    """One row for each entity with matches, as of a day: rate of the latest period and mean rate of the last three,
    episodes of the recent days (those without a start count as recent), their durations, muscle episodes and repeats,
    days since the last end or absence, units in a row up to the latest with an exposure of 60 or more, and the share of
    starts from which it was taken off early. Without episodes counts are 0 and durations null."""
    rates = period_rates(matches, schedule)
    ranked = N.top_per_group(rates, ["entity"], [F.desc("_first"), F.desc("period")], 3)
    base = ranked.groupBy("entity").agg(F.max(F.when(F.col("place") == 1, F.col("rate"))).alias("rate"), F.avg("rate").alias("rate_3"))
    from_day = F.date_sub(as_of, recent)
    late = lambda c: F.coalesce(F.col(c) >= from_day, F.lit(True))
    summary = span_summary(spans.where(late("start_day")), ["entity"], as_of)
    missed = absences.where(late("day")).groupBy("entity").agg(F.max("day").alias("_absent"))
    streak = N.trailing_streak(matches, ["entity"], [F.desc("ts"), F.desc("unit")], F.col("exposure") >= 60).withColumnRenamed("streak", "continuity")
    started = matches.where(~F.coalesce("substitute", F.lit(False))).select("entity", "unit")
    early = changes.where(F.contains(F.lower("event"), F.lit("subst")) & (F.coalesce("elapsed", F.lit(999)) < TAKEN_OFF)).select("entity", "unit").distinct().withColumn("_off", F.lit(1))
    off = started.join(early, ["entity", "unit"], "left").groupBy("entity").agg((F.count_distinct(F.when(F.col("_off") == 1, F.col("unit"))) / F.count("*")).alias("taken_off"))
    out = base
    for part in (summary, missed, streak, off):
        out = out.join(part, "entity", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("episodes", "muscle", "continuity")}
    return out.withColumns(zero | {"days_since": F.datediff(as_of, F.greatest("_last_end", "_absent"))}).drop("_last_end", "_absent")


def units_missed(spans: DataFrame, matches: DataFrame, schedule: DataFrame, as_of: Column) -> DataFrame:
    """spans with `missed`: units of the entity's team of the period that lie in the span, ends included, and in which the
    entity did not take part. An open end lasts to as_of, an open start begins at the end; repeated spans each get the
    number."""
    end = F.coalesce("end_day", as_of)
    closed = spans.withColumns({"_end": end, "_start": F.coalesce("start_day", end)})
    by_period = ["entity", "period"]
    team = A.modal(matches.repartition(*by_period), by_period, "team")
    sides = schedule.select("unit", "team", "period", F.col("day").alias("_day_at")).distinct()
    took_part = matches.where("exposure > 0").select("entity", "unit", "period").repartition(*by_period).distinct()
    played = took_part.join(team, by_period).join(sides, ["unit", "team", "period"]).where("_day_at IS NOT NULL")
    own = played.groupBy("entity", "_day_at").agg(F.count("*").alias("n")).groupBy("entity").agg(F.collect_list(F.struct("_day_at", "n")).alias("_own"))  # a day an entry
    within = F.filter("_own", lambda p: p["_day_at"].between(F.col("_start"), F.col("_end")))
    took = F.coalesce(F.aggregate(within, F.lit(0).cast("long"), lambda s, p: s + p["n"]), F.lit(0))
    closed = closed.join(own.hint("merge"), "entity", "left").withColumn("_took", took).drop("_own")
    there = J.count_within_held(closed, "entity", team, sides, ["team", "period"], "_start", "_end", "_day_at", "_n")
    return there.withColumn("missed", F.col("_n") - F.col("_took")).select(*spans.columns, "missed")


def training_rows(matches: DataFrame, schedule: DataFrame, spans: DataFrame, absences: DataFrame, born: DataFrame, least_units: int = 5, target: float = 0.75, recent: int = RECENT_DAYS, before_ref: bool = False) -> DataFrame:
    """One row for each entity and period that a later one follows, periods of under least_units units left out: history as
    of 31 December of the period, and whether the share of starts in the next period reaches target.

    Spans and absences count from `recent` days before that day; those without a date do not. With before_ref what begins
    after the day is left out as well. The rate is the mean share of starts over the periods since the year in which the
    recent days begin, continuity how many of the last of them in a row have a mean exposure of 60 or more. The next
    period's starts are divided by the units of its team (the last by name), its own units where the schedule lacks it.
    """
    starts = F.count_if(~F.coalesce("substitute", F.lit(False)))
    seen = matches.groupBy("entity", "period").agg(
        starts.alias("starts"), F.count("*").alias("n"), F.sum(F.coalesce("exposure", F.lit(0))).alias("exposure"), F.max("team").alias("team"), F.max("label").alias("label")
    ).where(F.col("n") >= least_units)
    units = schedule.groupBy("team", "period").agg(F.count("*").alias("_units"))
    rated = seen.join(units, ["team", "period"], "left").withColumn("share", F.col("starts") / F.coalesce("_units", "n"))
    pairs = J.period_transition(rated, "entity", ["period"], ["share", "period"])
    ref = F.make_date(F.substring("period", 1, 4).cast("int"), F.lit(12), F.lit(31))
    rows = pairs.select("entity", "period", "label", ref.alias("ref"), (F.col("next_share") >= target).cast("int").alias("target")).where("ref IS NOT NULL")

    held = rows.select("entity", "period", "ref")
    inside = lambda c: (F.col(c) >= F.date_sub("ref", recent)) & ((F.col(c) <= F.col("ref")) if before_ref else F.lit(True))
    summary = span_summary(held.join(spans, "entity").where(inside("start_day")), ["entity", "period", "ref"], F.col("ref"))
    absent = held.join(absences, "entity").where(inside("day")).groupBy("entity", "period").agg(F.max("day").alias("_absent"))
    past = held.join(seen.select("entity", F.col("period").alias("_p"), "starts", "n", "exposure"), "entity").where((F.col("_p") <= F.col("period")) & (F.substring("_p", 1, 4) >= F.year(F.date_sub("ref", recent)).cast("string")))
    rate = past.groupBy("entity", "period").agg(F.avg(F.col("starts") / F.col("n")).alias("rate"))
    streak = N.trailing_streak(past, ["entity", "period"], [F.desc("_p")], F.col("exposure") / F.col("n") >= 60).withColumnRenamed("streak", "continuity")
    out = rows.join(summary.drop("ref"), ["entity", "period"], "left")
    for part in (absent, rate, streak):
        out = out.join(part, ["entity", "period"], "left")
    out = out.join(born, "entity", "left")
    return out.select(
        "entity", "period", "rate", F.coalesce("episodes", F.lit(0)).alias("episodes"), "mean_days", "max_days", F.coalesce("muscle", F.lit(0)).alias("muscle"), "repeat_share",
        F.datediff("ref", F.greatest("_last_end", "_absent")).alias("days_since"), F.coalesce("continuity", F.lit(0)).alias("continuity"), F.coalesce(S.age_years(F.col("born"), F.col("ref")), F.lit(25.0)).alias("age"),
        F.coalesce(F.upper(F.substring("label", 1, 1)), F.lit("U")).alias("position_group"), "target",
    )
