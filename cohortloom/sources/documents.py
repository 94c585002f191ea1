"""JSON inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_SETS = "resultSets array<struct<name:string,headers:array<string>,rowSet:array<array<string>>>>"
SCHEDULE = (
    "events array<struct<id:string,date:string,name:string,"
    "competitions:array<struct<broadcasts:array<struct<media:struct<shortName:string>>>>>>>"
)
TEAMS = (
    "sports array<struct<leagues:array<struct<teams:array<struct<team:struct<id:string,location:string,"
    "displayName:string,abbreviation:string>>>>>>>"
)
GAME = (
    "plays array<struct<shootingPlay:boolean,scoringPlay:boolean,scoreValue:int,text:string,"
    "type:struct<text:string>,team:struct<id:string>,period:struct<number:int>,clock:struct<displayValue:string>,"
    "coordinate:struct<x:double,y:double>,participants:array<struct<athlete:struct<id:string>>>>>,"
    "boxscore struct<players:array<struct<team:struct<id:string>,"
    "statistics:array<struct<athletes:array<struct<athlete:struct<id:string,displayName:string>>>>>>>>,"
    "header struct<competitions:array<struct<neutralSite:boolean,conferenceCompetition:boolean,"
    "competitors:array<struct<id:string,homeAway:string>>>>>"
)
COORD_LIMIT = 100.0


def result_sets(df: DataFrame, body: str, keys: list[str], index: int = 0) -> DataFrame:
    """(keys, cells map): one row per row of result set `index`, cells by header."""
    parsed = df.select(*keys, F.from_json(body, RESULT_SETS)["resultSets"][index].alias("_s"))
    rows = parsed.select(*keys, F.col("_s.headers").alias("_h"), F.explode("_s.rowSet").alias("_r"))
    return rows.select(*keys, F.map_from_arrays("_h", "_r").alias("cells"))


def schedule(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(keys, game_id, date, name, broadcast): broadcasts joined by commas, null when none."""
    e = df.select(*keys, F.explode(F.from_json(body, SCHEDULE)["events"]).alias("e"))
    shows = F.transform(
        F.coalesce(F.try_element_at("e.competitions", F.lit(1))["broadcasts"], F.array()), lambda b: b["media"]["shortName"]
    )
    known = F.array_join(F.filter(shows, lambda s: s.isNotNull() & (s != "")), ",")
    return e.select(
        *keys, F.col("e.id").try_cast("long").alias("game_id"), F.col("e.date").alias("date"), F.col("e.name").alias("name"),
        F.nullif(known, F.lit("")).alias("broadcast"),
    )


def teams(df: DataFrame, body: str) -> DataFrame:
    t = df.select(F.explode(F.from_json(body, TEAMS)["sports"][0]["leagues"][0]["teams"]).alias("t"))
    return t.select(
        F.col("t.team.id").try_cast("long").alias("team_id"), F.col("t.team.location").alias("location"),
        F.col("t.team.displayName").alias("display_name"), F.col("t.team.abbreviation").alias("abbrev"),
    )


def parsed_games(df: DataFrame, body: str, key: str) -> DataFrame:
    """Parse once; shots, rosters and info are three selects off the result."""
    return df.select(key, F.from_json(body, GAME).alias("g"))


def _id(c: Column) -> Column:
    return c.try_cast("long")


def game_shots(games: DataFrame, key: str) -> DataFrame:
    """Field-goal attempts; sentinel or missing coordinates become null."""
    p = games.select(key, F.explode("g.plays").alias("p"))
    kind, text = F.coalesce("p.type.text", F.lit("")), F.coalesce("p.text", F.lit(""))
    free = F.lower(kind).contains("free") | F.lower(text).contains("free throw")
    p = p.where(F.coalesce("p.shootingPlay", F.lit(False)) & ~free)
    x, y = F.col("p.coordinate.x"), F.col("p.coordinate.y")
    valid = (F.abs(x) < COORD_LIMIT) & (F.abs(y) < COORD_LIMIT)
    who = F.col("p.participants")
    return p.select(
        key, F.coalesce(_id(F.col("p.team.id")), F.lit(-1)).alias("team_id"),
        _id(F.try_element_at(who, F.lit(1))["athlete"]["id"]).alias("athlete_id"),
        _id(F.try_element_at(who, F.lit(2))["athlete"]["id"]).alias("assist_athlete_id"),
        F.col("p.period.number").alias("period"), F.col("p.clock.displayValue").alias("clock"), kind.alias("shot_type"),
        F.col("p.text").alias("text"), F.coalesce("p.scoringPlay", F.lit(False)).alias("made"),
        F.col("p.scoreValue").alias("score_value"), F.when(valid, x).alias("x"), F.when(valid, y).alias("y"),
    )


def game_rosters(games: DataFrame, key: str) -> DataFrame:
    t = games.select(key, F.explode("g.boxscore.players").alias("t"))
    s = t.select(key, F.coalesce(_id(F.col("t.team.id")), F.lit(-1)).alias("team_id"), F.explode("t.statistics").alias("s"))
    a = s.select(key, "team_id", F.explode("s.athletes").alias("a"))
    return a.select(
        key, "team_id", _id(F.col("a.athlete.id")).alias("athlete_id"), F.col("a.athlete.displayName").alias("athlete_name")
    ).where("athlete_id is not null").dropDuplicates()


def game_info(games: DataFrame, key: str) -> DataFrame:
    comp = F.try_element_at("g.header.competitions", F.lit(1))
    home = F.try_element_at(F.filter(comp["competitors"], lambda c: c["homeAway"] == "home"), F.lit(1))
    return games.select(
        key, F.coalesce(F.size("g.plays"), F.lit(0)).alias("n_plays"),
        F.coalesce(comp["neutralSite"], F.lit(False)).alias("neutral_site"),
        F.coalesce(comp["conferenceCompetition"], F.lit(False)).alias("conference_game"),
        F.coalesce(_id(home["id"]), F.lit(-1)).alias("home_team_id"),
    )
