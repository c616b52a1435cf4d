"""Landed JSON payloads of entities and units as rows: events, bios, transfers and absences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrank.functions import scalars as S
from cohortrank.sources.files import require

# The fields of the payloads.
NAMED = "struct<id:string, name:string>"
EVENT = f"struct<time:struct<elapsed:string, extra:string>, team:{NAMED}, player:{NAMED}, assist:{NAMED}, type:string, detail:string, comments:string>"
PERSON = "struct<id:string, name:string, nationality:string, birth:struct<date:string>, age:string, height:string, weight:string, photo:string>"
BIO = f"struct<player:{PERSON}, statistics:array<struct<team:{NAMED}, league:{NAMED}>>>"
MOVES = f"struct<player:{NAMED}, transfers:array<struct<date:string, type:string, teams:struct<`in`:{NAMED}, out:{NAMED}>>>>"
ABSENCE = "struct<type:string, start:string, `end`:string>"
INJURY = f"struct<player:{NAMED}, fixture:struct<id:string, date:string>, type:string, reason:string, date:string>"


def items(payloads: DataFrame, kind: str, keys: list[str], body: str) -> DataFrame:
    """keys and one item x for each element of each landed array."""
    return payloads.select(*keys, F.explode(F.from_json(body, f"array<{kind}>")).alias("x"))


def day(text: Column) -> Column:
    """The date that starts a text, null for other text."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def whole(text: Column) -> Column:
    return S.tolerant_int(text)


def unit_events(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per event of each unit's payload (fixture_id, body)."""
    x = items(payloads, EVENT, ["fixture_id"], body)
    return x.select(
        "fixture_id", whole(F.col("x.time.elapsed")).alias("time_elapsed"), whole(F.col("x.time.extra")).alias("time_extra"), F.col("x.type").alias("event_type"), F.col("x.detail").alias("event_detail"),
        whole(F.col("x.player.id")).alias("player_id"), F.col("x.player.name").alias("player_name"), whole(F.col("x.assist.id")).alias("assist_player_id"), F.col("x.assist.name").alias("assist_player_name"),
        F.col("x.team.name").alias("team"), F.col("x.comments").alias("comments"),
    )


def bios(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per entity with an id; its team and cohort are those of the first statistics block."""
    x = items(payloads, BIO, [], body).withColumn("first", F.try_element_at("x.statistics", F.lit(1)))
    person = lambda c: F.col(f"x.player.{c}")
    return x.where(person("id").isNotNull()).select(
        whole(person("id")).alias("player_id"), person("name").alias("player_name"), person("nationality").alias("nationality"), day(F.col("x.player.birth.date")).alias("birth_date"), S.tolerant_double(person("age")).alias("current_age_years"),
        S.unit_stripped(person("height")).alias("height_cm"), S.unit_stripped(person("weight")).alias("weight_kg"), person("photo").alias("photo_url"),
        F.col("first.team.name").alias("current_team"), whole(F.col("first.league.id")).alias("current_league_id"),
    )


def transfers(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per move of each entity."""
    moves = items(payloads, MOVES, [], body).select(whole(F.col("x.player.id")).alias("player_id"), F.explode("x.transfers").alias("t"))
    side = lambda c: (F.col(f"t.teams.{c}.name").alias(f"team_{c}"), whole(F.col(f"t.teams.{c}.id")).alias(f"team_{c}_id"))
    return moves.select("player_id", day(F.col("t.date")).alias("date"), F.col("t.type").alias("type"), *side("in"), *side("out"))


def absences(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per absence of the entity that a payload (player_id, body) is about."""
    return items(payloads, ABSENCE, ["player_id"], body).select("player_id", F.col("x.type").alias("type"), day(F.col("x.start")).alias("start_date"), day(F.col("x.end")).alias("end_date"))


def injuries(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per injury; its day is the unit's, else its own."""
    x = items(payloads, INJURY, [], body)
    return x.select(
        whole(F.col("x.player.id")).alias("player_id"), whole(F.col("x.fixture.id")).alias("fixture_id"), F.col("x.type").alias("type"), F.col("x.reason").alias("reason"), day(F.coalesce("x.fixture.date", "x.date")).alias("date"),
    )


def reference_json(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """A reference file of one JSON object or array of them; raises MissingColumns if it lacks any of needed."""
    df = spark.read.option("multiLine", True).json(path)
    require(df.columns, needed)
    return df


def plain_name(text: Column) -> Column:
    """Header text as a column name: lower case, letters and digits, single underscores between."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def plain_names(headers: list[str | tuple[str, ...]]) -> list[str]:
    """Column names of headers of one or more levels, for DataFrame.toDF(); levels that are blank or unnamed go, a per
    cent sign is written out."""
    out = []
    for header in headers:
        levels = header if isinstance(header, tuple) else (header,)
        text = "_".join(x.strip() for x in levels if x.strip() and "Unnamed" not in x).lower().replace("%", "pct")
        out.append("_".join("".join(c if c.isalnum() else " " for c in text).split()))
    return out
