"""Profiles of use: what entities start as and where, held against the limits of a role, and internal options in their way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S


@dataclass(frozen=True)
class Limit:
    """A share that must be at least or at most so much, told only from `enough` rows on."""

    share: str
    rows: str
    words: str
    least: float | None = None
    most: float | None = None
    enough: int = 5


@dataclass(frozen=True)
class Role:
    """Limits of a role. None and () mean no limit; a role without any passes all."""

    min_height: float | None = None
    limits: tuple[Limit, ...] = ()


def usage(lineups: DataFrame, keys: list[str], shared_lines: bool = False) -> DataFrame:
    """Per keys, over the starters of lineups (keys, unit, team, is_starter, label, grid): label_rows and the shares of them that are
    F and M; zone_rows and the shares of them that are central and wide. Zone rows are F and M from line 3 on ('line:place' is
    the grid) that are one of both: central is the only place of a line, F in a line of two, or an inner place; wide is an
    edge of a line of three or more. A line is as wide as its largest place, among the rows of one key, or of all in the
    unit and team with shared_lines. Other labels, null labels and grids of another form are in no zone; shares of no
    rows are null. The window's keys hold few rows each, so no entity's rows meet in one task before they are counted."""
    part = lambda k: F.regexp_extract(F.coalesce("grid", F.lit("")), r"^(\d+):(\d+)$", k).try_cast("int")
    s = lineups.where("is_starter").select(*keys, "unit", "team", "label", part(1).alias("line"), part(2).alias("place"))
    zone = F.coalesce(F.col("label").isin("F", "M") & (F.col("line") >= 3) & F.col("place").isNotNull(), F.lit(False))
    line = W.partitionBy(*([] if shared_lines else keys), "unit", "team", "line")
    s = s.withColumn("zone", zone).withColumn("width", F.max(F.when(F.col("zone"), F.col("place"))).over(line))
    width, place = F.col("width"), F.col("place")
    central = (width == 1) | ((width == 2) & (F.col("label") == "F")) | ((width >= 3) & (place > 1) & (place < width))
    wide = (width >= 3) & ((place == 1) | (place == width))
    seen = F.col("zone") & (central | wide)
    share = lambda flag, of: F.avg(F.when(of, flag.cast("int")))
    known = F.col("label").isNotNull()
    return s.groupBy(*keys).agg(
        F.count("label").alias("label_rows"), share(F.col("label") == "F", known).alias("forward_share"), share(F.col("label") == "M", known).alias("midfield_share"),
        F.count_if(seen).alias("zone_rows"), share(central, seen).alias("central_share"), share(wide, seen).alias("wide_share"),
    )


def role_gate(role: Role) -> Column:
    """struct(result, detail): a limit that is broken fails; else what cannot be told is a caution; the messages of what
    decided are joined by ' ; '. Needs height and the columns of usage(); a null share breaks no limit."""
    number = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    broken, unknown = [], []
    if role.min_height is not None:
        height = F.col("height")
        broken.append(F.when(height < role.min_height, F.concat(F.lit("height "), height.cast("string"), F.lit(f" is below {role.min_height:g}"))))
        unknown.append(F.when(height.isNull(), F.lit("height is not known")))
    for x in role.limits:
        enough = F.coalesce(F.col(x.rows) >= x.enough, F.lit(False))
        value = S.settled(F.col(x.share))
        for limit, over, word in ((x.least, lambda v, to: v < to, "below"), (x.most, lambda v, to: v > to, "above")):
            if limit is not None:
                broken.append(F.when(enough & over(value, limit), F.concat(F.lit(f"{x.words} "), number(x.share), F.lit(f" is {word} {limit:.2f}"))))
    for rows, least in dict.fromkeys((x.rows, x.enough) for x in role.limits):
        unknown.append(F.when(F.coalesce(F.col(rows), F.lit(0)) < least, F.lit(f"fewer than {least} {rows.replace('_', ' ')}")))
    none = F.array().cast("array<string>")
    fails, cautions = (F.array_compact(F.array(*x)) if x else none for x in (broken, unknown))
    result = F.when(F.size(fails) > 0, "fail").when(F.size(cautions) > 0, "caution").otherwise("pass")
    return F.struct(result.alias("result"), F.array_join(F.when(F.size(fails) > 0, fails).otherwise(cautions), " ; ").alias("detail"))


def pathways(candidates: DataFrame, options: DataFrame, segment: str = "segment", ready: int = 12, later: int = 24, years: int = 2) -> DataFrame:
    """candidates (segment, age, contract_years) with pathway and pathway_soft, by the segment's internal option (segment,
    option_months, option_age). An option ready in under `ready` months blocks (fail) candidates of at most its age on
    contracts of over `years` years; one ready from then to `later` months makes such contracts an exception. An option
    or an age that is not known blocks nothing. A segment has one option; candidates without segment or option pass."""
    held = candidates.join(options.select(F.col(segment).alias("_segment"), "option_months", "option_age"), F.col(segment) == F.col("_segment"), "left").drop("_segment")
    long = F.col("contract_years") > years
    hard = (F.col("option_months") < ready) & (F.col("age") <= F.col("option_age")) & long
    soft = F.col("option_months").between(ready, later) & long
    return held.withColumns({"pathway": F.when(hard, "fail").otherwise("pass"), "pathway_soft": F.when(soft, "exception").otherwise("pass")}).drop("option_months", "option_age")
