"""Data-quality checks as one (check, value, status) table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineup.constants import TEAM_ABBREVIATIONS


def _checks(one_row: DataFrame, *checks) -> DataFrame:
    """``(check, value, status)`` rows of a one-row table."""
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), value.cast("string").alias("value"), status.alias("status"))
        for name, value, status in checks])))


def _none(n) -> Column:
    return F.when(n == 0, "ok").otherwise("warn")


def data_quality(games: DataFrame, features: DataFrame | None, odds: DataFrame | None,
                 teams: DataFrame, game_key: str = "game_id", date: str = "game_date",
                 team_cols=("team_abbreviation_home", "team_abbreviation_away"),
                 name_cols=("team_name_home", "team_name_away"),
                 odds_range=(1.01, 50.0), as_of=None, max_age_days: int = 7) -> DataFrame:
    """A26 + A27: record counts ("missing" when a source is absent), date range and latest
    date, duplicate game ids, prices outside a plausible decimal range, and
    expected participants never seen, and pairs of name and abbreviation that differ from the
    fixed table.  Each source is aggregated once, whatever the number of its checks.

    ``latest_date`` warns when the features end before the games do or, with ``as_of`` (a date), more
    than ``max_age_days`` before that day; ``games_date_range`` warns when there is no date or one after
    ``as_of``.  Holes inside seasons are found by ``calendar_gaps``."""
    ids = games.groupBy(game_key).agg(F.count(F.lit(1)).alias("c"), F.min(date).alias("lo"), F.max(date).alias("hi"))
    g = ids.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                F.count_if(F.col("c") > 1).alias("dup"))
    day = F.lit(as_of).cast("date") if as_of is not None else None
    ranged = F.col("hi").isNotNull() if day is None else F.coalesce(F.to_date("hi") <= day, F.lit(False))
    parts = [_checks(
        g, ("games_records", F.col("n"), F.when(F.col("n") > 0, "ok").otherwise("empty")),
        ("games_date_range", F.concat_ws(" .. ", F.col("lo").cast("string"), F.col("hi").cast("string")),
         F.when(ranged, "ok").otherwise("warn")),
        ("duplicate_games", F.col("dup"), _none(F.col("dup"))))]

    full, short = zip(*TEAM_ABBREVIATIONS)
    named = games.select(F.explode(F.array(*[F.struct(F.col(n).alias("name"), F.col(a).alias("abbr"))
                                             for n, a in zip(name_cols, team_cols)])).alias("t")).select("t.*").distinct()
    known = F.element_at(F.map_from_arrays(F.array(*map(F.lit, full)), F.array(*map(F.lit, short))), F.col("name"))
    named = named.withColumns({"odd": ~F.coalesce(known == F.col("abbr"), F.lit(False)), "seen": F.lit(True)})
    both = teams.select("team", F.lit(True).alias("expected")).join(named, F.col("team") == F.col("abbr"), "full")
    n = both.agg(F.count_if(F.col("expected") & F.col("seen").isNull()).alias("missing"), F.count_if("odd").alias("odd"))
    parts.append(_checks(n, ("teams_missing", F.col("missing"), _none(F.col("missing"))),
                         ("team_names_inconsistent", F.col("odd"), _none(F.col("odd")))))
    if features is not None:
        f = features.agg(F.count(F.lit(1)).alias("n"), F.max(date).alias("hi"))
        f = f.withColumn("_games", g.select("hi").scalar())
        fresh = F.to_date("hi") >= F.to_date("_games")
        if day is not None:
            fresh = fresh & (F.to_date("hi") >= F.date_sub(day, max_age_days))
        parts.append(_checks(f, ("feature_records", F.col("n"), F.lit("ok")),
                             ("latest_date", F.col("hi"), F.when(fresh, "ok").otherwise("warn"))))
    else:
        parts.append(_checks(games.sparkSession.range(1), ("feature_records", F.lit("missing"), F.lit("missing")),
                             ("latest_date", F.lit("missing"), F.lit("missing"))))
    if odds is not None:
        lo, hi = odds_range
        bad = odds.agg(F.count_if((F.col("home_odds") < lo) | (F.col("home_odds") > hi) |
                                  (F.col("away_odds") < lo) | (F.col("away_odds") > hi)).alias("n"),
                       F.count_if(F.col("home_odds").isNull() | F.col("away_odds").isNull()).alias("m"))
        parts.append(_checks(bad, ("odds_out_of_range", F.col("n"), _none(F.col("n"))),
                             ("odds_missing", F.col("m"), _none(F.col("m")))))
    return reduce(DataFrame.unionByName, parts)


def calendar_gaps(team_games: DataFrame, min_missing: int, team: str = "team_name", season: str = "season_id",
                  date: str = "game_date", teams: list[str] | None = None) -> DataFrame:
    """Spans of a season's game days in which a participant should have played and did not.

    The expected calendar of a season is every day on which any game was played, numbered from 1; every
    participant of the season (and all of ``teams``, a fixed list, if given) is expected on it.  A span is a
    run of at least ``min_missing`` numbered days without a game of the participant, before its
    first and after its last included: ``team, season, gap_start, gap_end, missing_days``.  The numbers
    make runs from neighbours alone, so (day, participant) pairs are never multiplied out; a participant's
    games are first reduced to its days.  Rows with a NULL season, day or participant are left out.
    """
    rows = team_games.select(F.col(team).alias("team"), F.col(season).alias("season"), F.to_date(date).alias("day")).dropna()
    played = rows.distinct()
    days = rows.select("season", "day").distinct()
    own = Window.partitionBy("season")
    days = days.withColumns({"i": F.row_number().over(own.orderBy("day")), "last": F.count(F.lit(1)).over(own)})
    seen = played.join(days, ["season", "day"]).select("team", "season", "i")
    # one row before the first and one after the last day of every participant
    ends = days.select("season", "last").distinct()
    expected = played.select("team", "season").distinct()
    if teams is not None:
        fixed = ends.select(F.explode(F.array(*map(F.lit, teams))).alias("team"), "season")
        expected = expected.unionByName(fixed).distinct()
    borders = expected.join(ends, "season").select("team", "season", F.explode(F.array(F.lit(0), F.col("last") + 1)).alias("i"))
    w = Window.partitionBy("team", "season").orderBy("i")
    spans = seen.unionByName(borders.withColumn("i", F.col("i").cast("int"))).withColumn("before", F.lag("i").over(w))
    spans = spans.withColumn("missing_days", F.col("i") - F.col("before") - 1).where(F.col("missing_days") >= min_missing)
    first, end = days.select("season", F.col("i").alias("_a"), F.col("day").alias("gap_start")), days.select(
        "season", F.col("i").alias("_b"), F.col("day").alias("gap_end"))
    spans = spans.withColumns({"_a": F.col("before") + 1, "_b": F.col("i") - 1})
    return spans.join(first, ["season", "_a"]).join(end, ["season", "_b"]).select(
        "team", "season", "gap_start", "gap_end", F.col("missing_days").cast("int").alias("missing_days"))
