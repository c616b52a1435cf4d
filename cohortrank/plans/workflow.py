"""Longlists, promotion checks, backtests, calibration and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrank.functions.scalars import settled
from cohortrank.operators import windows as N
from cohortrank.operators.ranks import rank_table
from cohortrank.plans.gates import Brief, evaluate


def longlist(context: DataFrame, brief: Brief, columns: dict[str, Column], n: int = 60) -> DataFrame:
    """Gate all candidates, score those that pass and keep the n best: one plan with no driver loop."""
    passed = evaluate(context, brief).where("passed")
    return passed.withColumns(columns).orderBy(F.desc("composite"), "entity").limit(n)


def rank_auc(df: DataFrame, keys: list[str], score: str, hit: str) -> DataFrame:
    """Area under the curve per key by rank sums, ties at their mean rank; null unless both classes are there. The sums run
    over distinct scores, so a key may have any number of rows."""
    pos, neg = F.count_if(F.col(hit) == 1), F.count_if(F.col(hit) == 0)
    ranked = rank_table(df, keys, [score], [pos.alias("_p"), neg.alias("_q")])
    rank = F.col("_below") + (F.col("_ties") + 1) / 2.0
    g = ranked.groupBy(*keys).agg(F.sum(F.col("_p") * rank).alias("_s"), F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"))
    p, q = F.col("positives"), F.col("negatives")
    return g.select(*keys, "positives", "negatives", F.when((p > 0) & (q > 0), (F.col("_s") - p * (p + 1) / 2.0) / (p * q)).alias("auc"))


def precision_at(df: DataFrame, keys: list[str], order: list, hit: str, k: int = 20) -> DataFrame:
    return N.top_per_group(df, keys, order, k).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("precision"))


def calibration(df: DataFrame, keys: list[str], score: str, order: list[str], hit: str, limit: float = 0.05) -> DataFrame:
    """Per decile: mean of the predicted chance and of the outcome, and whether they are further apart than limit."""
    binned = N.equal_count_bins(df, order, 10, keys)
    g = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(hit).alias("actual"))
    return g.withColumn("alert", settled(F.abs(F.col("predicted") - F.col("actual"))) > limit)


def unmet(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that don't hold; null counts as not holding."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items())))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def resolve_period(periods: DataFrame, year: int) -> DataFrame:
    """The largest period before year, else the largest of all, as one row."""
    number = F.col("period").try_cast("int")
    return periods.agg(F.coalesce(F.max(F.when(number <= year - 1, number)), F.max(number)).alias("period"))


#: Fields that a brief needs, and the reasons that an override may give.
BRIEF_FIELDS = ["role_name", "archetype_primary", "intent", "budget_max_contract_years", "age_min", "age_max", "league_scope", "timeline", "created_by", "approved_by"]
OVERRIDE_REASONS = ["tactical", "financial", "medical", "intelligence", "alternatives", "timing"]


def brief_problems(briefs: DataFrame, fields: list[str] = BRIEF_FIELDS, checked: str = "pathway_check_done") -> DataFrame:
    """Each brief with missing (its fields that are null, blank or empty), pathway_open and valid."""
    kinds = dict(briefs.dtypes)
    empty = lambda c: F.coalesce(F.size(c) == 0 if kinds[c].startswith("array") else F.trim(F.col(c).cast("string")) == "", F.lit(True))
    held = briefs.withColumns({"missing": F.array_compact(F.array(*(F.when(empty(c), F.lit(c)) for c in fields))), "pathway_open": ~F.coalesce(F.col(checked), F.lit(False))})
    return held.withColumn("valid", (F.size("missing") == 0) & ~F.col("pathway_open"))


def split_overrides(overrides: DataFrame, reason: str = "reason_category") -> tuple[DataFrame, DataFrame]:
    """Overrides whose reason is one of the known ones, and the others."""
    known = F.coalesce(F.col(reason).isin(OVERRIDE_REASONS), F.lit(False))
    return overrides.where(known), overrides.where(~known)


def sound_rows(df: DataFrame, check: str = "quality_check") -> DataFrame:
    """Rows whose quality check holds or was not made."""
    return df.where(F.coalesce(F.col(check), F.lit(True)))


def review_rows(rows: DataFrame, cohort: int | None = None, period: str | None = None) -> DataFrame:
    """Review rows of a cohort and a period, of all where none is given."""
    for column, wanted in (("cohort", cohort), ("period", period)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    return rows


def review_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, those with candidates and without, and those with a suggested team."""
    some = F.coalesce(F.size("candidates") > 0, F.lit(False))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(some).alias("with_candidates"), F.count_if(~some).alias("without_candidates"), F.count_if(F.col("team").isNotNull()).alias("with_team"))


def in_windows(df: DataFrame, dates: list[str], day: str) -> DataFrame:
    """df once for each window date that is not before its day; the dates are few."""
    ends = F.array(*(F.lit(x).cast("date") for x in dates))
    return df.withColumn("window", F.explode(F.filter(ends, lambda x: x >= F.col(day))))


def windowed_calibration(df: DataFrame, dates: list[str], day: str, score: str, order: list[str], hit: str, limit: float = 0.05) -> DataFrame:
    """The calibration curve of each window date: per decile of the rows up to it the mean predicted chance, the mean
    outcome, and whether they are further apart than limit."""
    return calibration(in_windows(df, dates, day), ["window"], score, order, hit, limit)


def windowed_backtest(df: DataFrame, dates: list[str], day: str, score: str, hit: str, order: list, k: int = 20) -> DataFrame:
    """Per window date, over the rows up to it: area under the curve and precision of the k best; null where there are
    no rows or only one class. The dates are few, so a row is repeated for each window that it is in."""
    windows = df.sparkSession.createDataFrame([(x,) for x in dates], "window string").select(F.to_date("window").alias("window"))
    rows = in_windows(df, dates, day).withColumn(score, F.coalesce(F.col(score), F.lit(0)))
    both = rank_auc(rows, ["window"], score, hit).join(precision_at(rows, ["window"], order, hit, k).select("window", "precision"), "window")
    known = F.col("auc").isNotNull()
    return windows.join(both, "window", "left").select("window", "auc", F.when(known, F.col("precision")).alias("precision"))


#: What a review needs, and the archetypes that need imports too.
NOTES_NEEDED, IMPORTS_NEEDED, SURE_RATING = 3, 6, 4
IMPORT_ARCHETYPES = ["championship_transition", "emerging_asset"]


def readiness(targets: DataFrame, notes: DataFrame, imports: DataFrame) -> DataFrame:
    """targets (entity, archetype) with missing, the names of what a review still lacks, and ready.

    notes: entity, text, rating; imports: entity. Notes count by number, one must name a top-6 side, and one must say that
    the entity fits the system or rate it so.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    n = notes.groupBy("entity").agg(F.count("*").alias("_n"), F.bool_or(text.contains("top-6")).alias("_top"), F.bool_or(text.contains("fits our system") | F.coalesce(F.col("rating") >= SURE_RATING, F.lit(False))).alias("_fit"))
    held = targets.join(n, "entity", "left").join(imports.groupBy("entity").agg(F.count("*").alias("_i")), "entity", "left")
    need = F.coalesce(F.col("archetype").isin(IMPORT_ARCHETYPES), F.lit(False))
    missing = unmet({"notes": F.col("_n") >= NOTES_NEEDED, "top-6": F.col("_top"), "system fit": F.col("_fit"), "imports": ~need | (F.coalesce("_i", F.lit(0)) >= IMPORTS_NEEDED)})
    return held.withColumn("missing", missing).withColumn("ready", F.size("missing") == 0).drop("_n", "_top", "_fit", "_i")
