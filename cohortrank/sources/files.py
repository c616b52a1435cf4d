"""Landed files as DataFrames: CSV exports, workbooks' CSV parts, JSON payloads, and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrank.functions import scalars as S
from cohortrank.operators.joins import latest_per_key


class MissingColumns(ValueError):
    """A file lacks columns that its job needs."""


def require(columns: list[str], needed: list[str]) -> None:
    if missing := [c for c in needed if c not in columns]:
        raise MissingColumns(", ".join(missing))


def read_csv(spark: SparkSession, path: str, needed: list[str], cohorts: list[int] | None = None, periods: list[str] | None = None) -> DataFrame:
    """A bulk CSV, all columns as text; filters go to the scan. Raises MissingColumns if any of needed is absent."""
    df = spark.read.option("header", True).csv(path)
    require(df.columns, needed)
    if cohorts is not None:
        df = df.where(S.tolerant_int(F.col("league_id")).isin(cohorts))
    if periods is not None:
        df = df.where(F.col("season").isin(periods))
    return df


def split_rejects(df: DataFrame, ids: list[str], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all ids above 0 and no blank name, and the others."""
    good = F.lit(True)
    for c in ids:
        good = good & F.coalesce(S.tolerant_int(F.col(c)) > 0, F.lit(False))
    for c in names:
        good = good & S.clean_text(F.col(c)).isNotNull()
    return df.where(good), df.where(~good)


def three_tables(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units (last row per id), latest row per entity (ties to the later row) and facts of one bulk scan. Needs a
    sequence column seq."""
    units = latest_per_key(df, ["fixture_id"], [F.desc("seq")]).select("fixture_id", "league_id", "season", "date", "home_team", "away_team")
    entities = latest_per_key(df, ["player_id"], [F.desc("date"), F.desc("seq")]).select("player_id", "player_name", "team", "position")
    return units, entities, df.drop("player_name", "home_team", "away_team", "seq")


def single_row(df: DataFrame) -> DataFrame:
    """Each file's only row as (file, payload map); files with another number of rows go to an error column."""
    cols = df.columns
    named = df.select(F.col("_metadata.file_path").alias("file"), F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*(F.col(c).cast("string") for c in cols))).alias("payload"))
    rows = named.groupBy("file").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    return rows.select("file", F.when(F.col("n") == 1, F.col("payload")).alias("payload"), F.when(F.col("n") != 1, F.concat(F.lit("expected one row, found "), F.col("n").cast("string"))).alias("error"))


def merge_cohort_files(df: DataFrame, keys: list[str], exposure: str, count: str) -> DataFrame:
    """Rows of a folder's files with one key merged: the fuller, then the one of more exposure, then of more units."""
    from cohortrank.operators.aggregates import prefer_fuller

    payload = [c for c in df.columns if c not in keys]
    return prefer_fuller(df, keys, payload, [F.desc(exposure), F.desc(count)])


def cohort_of_path(path: Column, aliases: dict[str, int]) -> Column:
    """Cohort id by the name of the folder that holds the file."""
    folder = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    out = F.lit(None).cast("int")
    for name, cohort in aliases.items():
        out = F.when(folder == name.lower(), cohort).otherwise(out)
    return out


#: Statuses of completed units.
COMPLETED = ["FT", "AET", "PEN"]

FIXTURE = "fixture struct<id:int, date:string, status:struct<short:string>>, league struct<id:int, season:int>, teams struct<home:struct<name:string>, away:struct<name:string>>"


def completed_units(payloads: DataFrame, body: str = "body", seq: str = "seq") -> DataFrame:
    """Completed units of landed JSON arrays, the last of each id."""
    rows = payloads.select(F.explode(F.from_json(body, f"array<struct<{FIXTURE}>>")).alias("x"), seq)
    flat = rows.select(F.col("x.fixture.id").alias("fixture_id"), F.col("x.league.id").alias("league_id"), F.col("x.league.season").cast("string").alias("season"), F.to_date("x.fixture.date").alias("date"), F.col("x.teams.home.name").alias("home_team"), F.col("x.teams.away.name").alias("away_team"), F.col("x.fixture.status.short").alias("status"), seq)
    return latest_per_key(flat.where(F.col("status").isin(COMPLETED)), ["fixture_id"], [F.desc(seq)]).drop(seq)


STATISTICS = "array<struct<team:struct<name:string>, players:array<struct<player:struct<id:int, name:string>, statistics:array<struct<games:struct<minutes:int, position:string, rating:string, substitute:boolean>, shots:struct<total:int, `on`:int>, goals:struct<total:int, assists:int>, passes:struct<total:int, key:int, accuracy:string>>>>>>>"


def unit_facts(payloads: DataFrame, units: DataFrame, body: str = "body") -> DataFrame:
    """One row per entity of each unit's statistics payload (fixture_id, body); only the first statistics block counts."""
    teams = payloads.select("fixture_id", F.explode(F.from_json(body, STATISTICS)).alias("t"))
    players = teams.select("fixture_id", F.col("t.team.name").alias("team"), F.explode("t.players").alias("p"))
    s = F.try_element_at("p.statistics", F.lit(1))
    facts = players.select(
        "fixture_id", "team", F.col("p.player.id").alias("player_id"), s["games"]["minutes"].alias("minutes"), s["games"]["position"].alias("position"), S.tolerant_double(s["games"]["rating"]).alias("rating"),
        s["games"]["substitute"].alias("is_substitute"), s["shots"]["total"].alias("shots_total"), s["goals"]["total"].alias("goals_scored"), s["passes"]["total"].alias("passes_total"), S.tolerant_double(s["passes"]["accuracy"]).alias("pass_accuracy"),
    )
    return facts.join(units.select("fixture_id", "home_team"), "fixture_id").withColumn("is_home", F.col("team") == F.col("home_team")).drop("home_team")


def team_statistics(payloads: DataFrame, body: str = "body") -> DataFrame:
    """{type, value} arrays as one map per unit and team; keys are lower-cased and trimmed, 'expected goals' falls
    back to 'xg'."""
    rows = payloads.select("fixture_id", F.explode(F.from_json(body, "array<struct<team:struct<name:string>, statistics:array<struct<type:string, value:string>>>>")).alias("t"))
    entries = F.transform("t.statistics", lambda x: F.struct(F.lower(F.trim(x["type"])).alias("k"), x["value"].alias("v")))
    named = rows.select("fixture_id", F.col("t.team.name").alias("team"), F.map_from_entries(entries).alias("stats"))
    get = lambda k: S.tolerant_double(F.try_element_at("stats", F.lit(k)))
    return named.select("fixture_id", "team", get("total shots").alias("shots_total"), get("ball possession").alias("possession"), F.coalesce(get("expected goals"), get("xg")).alias("expected_goals"))


def lineups(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Starters and substitutes of each unit, tagged."""
    player = "struct<player:struct<id:int, name:string, pos:string, grid:string>>"
    rows = payloads.select("fixture_id", F.explode(F.from_json(body, f"array<struct<team:struct<name:string>, startXI:array<{player}>, substitutes:array<{player}>>>")).alias("t"))
    tagged = lambda c, flag: F.transform(F.coalesce(c, F.array().cast(f"array<{player}>")), lambda x: F.struct(x["player"].alias("p"), F.lit(flag).alias("is_starter")))
    both = F.concat(tagged(F.col("t.startXI"), True), tagged(F.col("t.substitutes"), False))
    return rows.select("fixture_id", F.col("t.team.name").alias("team"), F.explode(both).alias("x")).select("fixture_id", "team", F.col("x.p.id").alias("player_id"), F.col("x.p.pos").alias("position_label"), F.col("x.p.grid").alias("grid_position"), F.col("x.is_starter").alias("is_starter"))


def standings(payloads: DataFrame, as_of: str, body: str = "body") -> DataFrame:
    """Nested standing arrays flattened and stamped with the day of the run."""
    rows = payloads.select(F.explode(F.flatten(F.from_json(body, "array<array<struct<rank:int, team:struct<name:string>, points:int>>>"))).alias("x"), "league_id")
    return rows.select("league_id", F.lit(as_of).cast("date").alias("date"), F.col("x.team.name").alias("team_name"), F.col("x.rank").alias("position"), F.col("x.points").alias("points"))


def rename_cast(df: DataFrame, mapping: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Columns renamed and cast by a mapping kept as data (new name: old name, type); absent ones are null, rows
    with a null key go."""
    cols = [(F.col(old).try_cast(kind) if old in df.columns else F.lit(None).cast(kind)).alias(new) for new, (old, kind) in mapping.items()]
    return df.select(*cols).where(" AND ".join(f"{k} IS NOT NULL" for k in keys))


def embedded_series(pages: DataFrame, html: str = "html", variable: str = "series") -> DataFrame:
    """(url, day, value) of a JSON array assigned to a script variable; x is milliseconds since 1970."""
    body = F.regexp_extract(html, rf"{variable}\s*=\s*(\[.*?\])\s*;", 1)
    points = F.from_json(F.when(body != "", body), "array<struct<x:bigint, y:double>>")
    return pages.select("url", F.explode(points).alias("p")).select("url", F.to_date(F.timestamp_millis("p.x")).alias("day"), F.col("p.y").alias("value"))
