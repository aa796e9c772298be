"""Prices and predictions: winner pick, edges, consensus and odds joins
(F2-F7, J-1, J-2, J-3, J-4, A23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineup.constants import (HOME_POINTS_BOOST, HOME_WIN_SHIFT, LEAGUE_AVERAGE_PROFILE,
                              TEAM_ABBREVIATIONS, TEAM_PROFILES, WIN_RATE_CLAMP)
from lineup.functions import odds as O


def pick_winner(pred: DataFrame) -> DataFrame:
    """home wins only if strictly more likely (a tie picks away);
    confidence is the larger probability."""
    return pred.withColumns({
        "predicted_winner": F.when(F.col("home_prob") > F.col("away_prob"), F.col("home_team"))
                             .otherwise(F.col("away_team")),
        "confidence": F.greatest("home_prob", "away_prob"),
    })


def pair_games(team_probs: DataFrame, game: str = "game_id", team: str = "team",
               is_home: str = "is_home", prob: str = "p",
               keep=("game_date",)) -> DataFrame:
    """J-4 + F3 + F4: two scored participant rows -> one game row.

    Rows are paired by key (``game``, ``is_home``), never by position; the two
    probabilities are normalised to sum to 1 when their sum is positive.
    """
    h, a = F.col(is_home), ~F.col(is_home)
    aggs = [F.max(F.when(h, F.col(team))).alias("home_team"),
            F.max(F.when(a, F.col(team))).alias("away_team"),
            F.max(F.when(h, F.col(prob))).alias("_ph"),
            F.max(F.when(a, F.col(prob))).alias("_pa")]
    aggs += [F.first(c).alias(c) for c in keep]
    g = team_probs.groupBy(game).agg(*aggs)
    g = g.withColumns({"home_prob": O.normalize_pair("_ph", "_pa"),
                       "away_prob": O.normalize_pair("_pa", "_ph")}).drop("_ph", "_pa")
    return pick_winner(g)


def betting_edges(pred: DataFrame) -> DataFrame:
    """F2 + F5-F7: implied probabilities from decimal odds, edges, and the
    better side.  A NULL comparison picks the away side; the best edge is NULL
    when either edge is NULL."""
    he, ae = F.col("home_edge"), F.col("away_edge")
    df = pred.withColumns({
        "home_implied_prob": O.decimal_to_prob("home_odds"),
        "away_implied_prob": O.decimal_to_prob("away_odds"),
    }).withColumns({
        "home_edge": O.edge("home_prob", "home_implied_prob"),
        "away_edge": O.edge("away_prob", "away_implied_prob"),
    })
    home_better = F.coalesce(he > ae, F.lit(False))
    return df.withColumns({
        "best_bet_team": F.when(home_better, F.col("home_team")).otherwise(F.col("away_team")),
        "best_bet_edge": O.both_greatest(he, ae),
        "best_bet_prob": F.when(home_better, F.col("home_prob")).otherwise(F.col("away_prob")),
        "best_bet_odds": F.when(home_better, F.col("home_odds")).otherwise(F.col("away_odds")),
    })


def decimal_quotes(odds_by_book: DataFrame) -> DataFrame:
    """The American quotes of ``flatten_odds`` as decimal ones."""
    return odds_by_book.withColumns({c: O.american_to_decimal(c) for c in ("home_odds", "away_odds")})


def odds_consensus(odds_by_book: DataFrame, keys=("game_date", "home_team", "away_team")) -> DataFrame:
    """Mean decimal price per side across bookmakers; NULL when no book quotes it.
    One partial aggregation per game (map-side combine).  Prices must be decimal: a
    mean of American quotes means nothing (``decimal_quotes`` converts them)."""
    return odds_by_book.groupBy(*keys).agg(F.avg("home_odds").alias("home_odds"),
                                           F.avg("away_odds").alias("away_odds"),
                                           F.count(F.lit(1)).alias("n_books"))


def join_odds(schedule: DataFrame, consensus: DataFrame,
              keys=("game_date", "home_team", "away_team")) -> DataFrame:
    """J-1 with Q7 fixed: left join the schedule to consensus odds; the odds
    already on the schedule are kept when the join finds none."""
    c = consensus.select(*keys, F.col("home_odds").alias("_ho"), F.col("away_odds").alias("_ao"))
    j = schedule.join(c, list(keys), "left")
    cols = {}
    for side, tmp in (("home_odds", "_ho"), ("away_odds", "_ao")):
        cols[side] = F.coalesce(F.col(tmp), F.col(side)) if side in schedule.columns else F.col(tmp)
    return j.withColumns(cols).drop("_ho", "_ao")


def closing_quotes(schedule: DataFrame, quotes: DataFrame, key: str = "game_id", tip_off: str = "commence_time",
                   seen: str = "snapshot_ts", book: str = "bookmaker") -> DataFrame:
    """J-1 as of tip-off: for every game and bookmaker that ever quoted it the last quote seen before
    the game starts (NULL prices if all came later).  ``quotes`` hold decimal prices.  The pairs come from
    the quotes themselves, so no game is multiplied by all bookmakers."""
    from lineup.operators.asof import asof_join
    pairs = schedule.select(key, tip_off).join(quotes.select(key, book).distinct(), key)
    return asof_join(pairs, quotes, [key, book], tip_off, seen, [seen, "home_odds", "away_odds"])


def closing_odds(schedule: DataFrame, quotes: DataFrame, key: str = "game_id", **names) -> DataFrame:
    """The schedule with the mean closing price of each side over its bookmakers, how many had quoted in
    time, and when the newest of those quotes was seen; games never quoted keep NULLs."""
    seen = names.get("seen", "snapshot_ts")
    closing = closing_quotes(schedule, quotes, key, **names).groupBy(key).agg(
        F.avg("home_odds").alias("home_odds"), F.avg("away_odds").alias("away_odds"), F.count(seen).alias("n_books"),
        F.max(seen).alias("last_seen"))
    return schedule.join(closing, key, "left")


def team_dimension(spark: SparkSession) -> DataFrame:
    """The fixed 30-row name -> abbreviation table."""
    return spark.createDataFrame(TEAM_ABBREVIATIONS, "team_full_name string, team_abbr string")


def normalize_team(df: DataFrame, col: str, out: str = "team_abbr") -> DataFrame:
    """J-2: full team name -> abbreviation; unknown names -> first 3 letters
    upper-cased.  The dimension has a fixed 30 rows, so it is broadcast."""
    dim = F.broadcast(team_dimension(df.sparkSession)).withColumnRenamed("team_abbr", "_abbr")
    j = df.join(dim, df[col] == dim["team_full_name"], "left")
    return j.withColumn(out, F.coalesce(F.col("_abbr"), F.upper(F.substring(df[col], 1, 3)))) \
            .drop("_abbr", "team_full_name")


def team_profile_features(df: DataFrame, team: str = "team", is_home: str = "is_home") -> DataFrame:
    """J-3 + F13: profile features with home boost; other teams get the league
    average.  The profile table has a fixed 4 rows (broadcast)."""
    spark = df.sparkSession
    prof = F.broadcast(spark.createDataFrame(
        TEAM_PROFILES, "_pt string, _pts double, _pa double, _wp double"))
    j = df.join(prof, df[team] == prof["_pt"], "left")
    pts = F.coalesce(F.col("_pts"), F.lit(LEAGUE_AVERAGE_PROFILE[0]))
    pa = F.coalesce(F.col("_pa"), F.lit(LEAGUE_AVERAGE_PROFILE[1]))
    wp = F.coalesce(F.col("_wp"), F.lit(LEAGUE_AVERAGE_PROFILE[2]))
    h = F.col(is_home)
    boost = F.when(h, F.lit(HOME_POINTS_BOOST)).otherwise(F.lit(-HOME_POINTS_BOOST))
    shift = F.when(h, F.lit(HOME_WIN_SHIFT)).otherwise(F.lit(-HOME_WIN_SHIFT))
    rate = O.clamp(wp + shift, *WIN_RATE_CLAMP)
    return j.withColumns({
        "is_home_int": h.cast("int"),
        "avg_pts_last_10": pts + boost,
        "avg_pts_allowed_last_10": pa - boost * 0.5,
        "avg_point_diff_last_10": (pts - pa) + boost,
        "win_pct_last_10": rate,
        "win_pct_last_5": rate,
        "avg_point_diff_last_5": (pts - pa) + boost,
        "season_win_pct": wp,
        "season_avg_pts": pts,
        "season_avg_pts_allowed": pa,
    }).drop("_pt", "_pts", "_pa", "_wp")
