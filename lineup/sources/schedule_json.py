"""Scoreboard documents of two shapes -> one schedule schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineup.functions.calendar import local_game_date

SCHEDULE_COLUMNS = ["game_id", "game_date", "home_team", "away_team", "game_time",
                    "game_status", "arena", "home_odds", "away_odds"]


def _get(v: str, path: str, typ: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{typ}')")


def flatten_scoreboard(docs: DataFrame, doc_col: str = "doc", target_date=None,
                       fixed_date: bool = False) -> DataFrame:
    """Shape A: ``scoreboard.games[]``.  The game date is the local date of
    the UTC start (-5 h as the reference does; ``fixed_date`` uses the real
    zone).  ``target_date`` keeps only that date; a missing arena is ''; a start that is
    not a time gives a NULL game date and keeps its row."""
    v = docs.select(F.try_parse_json(F.col(doc_col)).alias("_v"))
    g = v.select(F.explode(_get("_v", "$.scoreboard.games", "array<variant>")).alias("_g"))
    t = _get("_g", "$.gameTimeUTC")
    out = g.select(
        _get("_g", "$.gameId").alias("game_id"),
        local_game_date(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), fixed_date).alias("game_date"),
        _get("_g", "$.homeTeam.teamTricode").alias("home_team"),
        _get("_g", "$.awayTeam.teamTricode").alias("away_team"),
        t.alias("game_time"),
        _get("_g", "$.gameStatus").alias("game_status"),
        F.coalesce(_get("_g", "$.arenaName"), F.lit("")).alias("arena"),
        F.lit(None).cast("double").alias("home_odds"),
        F.lit(None).cast("double").alias("away_odds"),
    )
    if target_date is not None:
        out = out.where(F.col("game_date") == F.lit(target_date).cast("date"))
    return out


def flatten_events(docs: DataFrame, doc_col: str = "doc", target_date=None) -> DataFrame:
    """Shape B: ``events[]``; home = the competitor with ``homeAway = 'home'``,
    away = the first other one; events with fewer than two competitors or a
    missing side are dropped.  The date is the requested date when given,
    else the event's own date."""
    v = docs.select(F.try_parse_json(F.col(doc_col)).alias("_v"))
    e = v.select(F.explode(_get("_v", "$.events", "array<variant>")).alias("_e"))
    e = e.withColumn("_c", F.expr("try_variant_get(_e, '$.competitions[0]')"))
    e = e.withColumn("_cs", _get("_c", "$.competitors", "array<variant>"))
    home = F.expr("get(filter(_cs, c -> try_variant_get(c, '$.homeAway', 'string') = 'home'), 0)")
    away = F.expr("get(filter(_cs, c -> coalesce(try_variant_get(c, '$.homeAway', 'string'), '') <> 'home'), 0)")
    e = e.withColumns({"_h": home, "_a": away})
    date = F.lit(target_date).cast("date") if target_date is not None else \
        F.try_to_date(F.substring(_get("_e", "$.date"), 1, 10), "yyyy-MM-dd")
    out = e.where(F.size("_cs") >= 2).select(
        _get("_e", "$.id").alias("game_id"),
        date.alias("game_date"),
        _get("_h", "$.team.abbreviation").alias("home_team"),
        _get("_a", "$.team.abbreviation").alias("away_team"),
        F.coalesce(_get("_e", "$.date"), F.lit("")).alias("game_time"),
        F.coalesce(_get("_c", "$.status.type.name"), F.lit("")).alias("game_status"),
        F.coalesce(_get("_c", "$.venue.fullName"), F.lit("")).alias("arena"),
        F.lit(None).cast("double").alias("home_odds"),
        F.lit(None).cast("double").alias("away_odds"),
    )
    return out.where("home_team is not null and away_team is not null")
