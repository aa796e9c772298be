"""Queries over the participant feature table."""

from __future__ import annotations

from lineup.config import FeatureConfig
from lineup.operators import games as G
from lineup.operators import windows as WN
from lineup.plans import derive
from lineup.plans.catalog import register
from lineup.plans.oracle import cte_team_games

CFG = FeatureConfig()
N, S = CFG.lookback, CFG.short
ROLL = [p.format(n=N) for _, p in CFG.rolling_measures] + [p.format(n=S) for _, p in CFG.short_measures]


def team_rows(spark, sf_dir):
    return G.team_games(derive.games(spark, sf_dir))


def _tasks(spark, sf_dir):
    """By the number of orders, which Parquet's footers tell: each gives two rows."""
    return WN.task_number(2 * derive.read(spark, sf_dir, "orders").count(), spark.sparkContext.defaultParallelism)


def features(spark, sf_dir, cfg=CFG, whole_group=True):
    return WN.participant_features(team_rows(spark, sf_dir), cfg, whole_group=whole_group, tasks=_tasks(spark, sf_dir))


# ---- oracle: every window feature written directly over the whole team ----
_W = "partition by team_name order by game_date, game_id"
_WS = "partition by team_name, season_id order by game_date, game_id"


def _roll(m: str, n: int, alias: str) -> str:
    fr = f"({_W} rows between {n} preceding and 1 preceding)"
    return f"case when count({m}) over {fr} = {n} then avg({m}) over {fr} end as {alias}"


def _venue(side: str, n: int) -> str:
    fr = f"({_W} rows between {n - 1} preceding and current row)"
    v = f"case when venue = '{side}' then lw end"
    return f"case when count({v}) over {fr} = {n} then avg({v}) over {fr} end as {side}_win_pct_last_{n}"


FEAT_SQL = (
    "with " + cte_team_games() + ", tl as (select *, lag(win_numeric) over (" + _W + ") as lw, "
    "lag(win_numeric) over (" + _WS + ") as s_w, lag(pts_for) over (" + _WS + ") as s_pf, "
    "lag(pts_against) over (" + _WS + ") as s_pa from tg), feat as (select *, " +
    ", ".join([_roll(m, N, p.format(n=N)) for m, p in CFG.rolling_measures] +
              [_roll(m, S, p.format(n=S)) for m, p in CFG.short_measures] +
              [_venue("home", N), _venue("away", N)]) +
    ", count(*) over (partition by team_name) - 1 as games_played"
    ", row_number() over (" + _W + ") - 1 as games_played_asof"
    ", cast(coalesce(date_diff('day', lag(game_date) over (" + _W + "), game_date), 2) as int) as rest_days"
    ", cast(rank() over (partition by team_name, season_id order by game_date) as double)"
    " + (count(*) over (partition by team_name, season_id, game_date) - 1) / 2e0 as game_number_in_season"
    ", avg(s_w) over (partition by team_name, season_id) as season_win_pct"
    ", avg(s_pf) over (partition by team_name, season_id) as season_avg_pts"
    ", avg(s_pa) over (partition by team_name, season_id) as season_avg_pts_allowed"
    ", avg(win_numeric) over (" + _WS + " rows between unbounded preceding and 1 preceding) as season_win_pct_asof"
    ", avg(pts_for) over (" + _WS + " rows between unbounded preceding and 1 preceding) as season_avg_pts_asof"
    ", avg(pts_against) over (" + _WS + " rows between unbounded preceding and 1 preceding)"
    " as season_avg_pts_allowed_asof"
    ", win as target_win from tl) "
)

FINAL = [c.format(n=N, s=S) for c in WN.FINAL_COLUMNS]
FINAL_DOUBLES = [c for c in FINAL if c.startswith(("avg_", "win_pct", "season_", "game_number"))]


@register("rolling_form", FEAT_SQL + "select game_id, team_name, " + ", ".join(ROLL) + " from feat",
          doubles=ROLL)
def rolling_form(spark, sf_dir):
    """W1 + W2: each participant's mean over its previous 10 (and 5) games."""
    return features(spark, sf_dir, whole_group=False).select("game_id", "team_name", *ROLL)


VENUE = [f"home_win_pct_last_{N}", f"away_win_pct_last_{N}"]


@register("venue_split_form", FEAT_SQL + "select game_id, team_name, venue, " + ", ".join(VENUE) +
          " from feat", doubles=VENUE)
def venue_split_form(spark, sf_dir):
    """W3 as the reference computes it: the previous result kept on same-venue rows only."""
    return features(spark, sf_dir, whole_group=False).select("game_id", "team_name", "venue", *VENUE)


@register("venue_form_by_venue",
          "with " + cte_team_games() + " select game_id, team_name, venue, case when count(win_numeric) "
          "over wv = 10 then avg(win_numeric) over wv end as venue_win_pct_last_n from tg window wv as "
          "(partition by team_name, venue order by game_date, game_id rows between 10 preceding and 1 preceding)",
          doubles=["venue_win_pct_last_n"])
def venue_form_by_venue(spark, sf_dir):
    """W3, useful form: previous 10 games at the same venue."""
    return WN.venue_form(team_rows(spark, sf_dir), N, tasks=_tasks(spark, sf_dir)).select(
        "game_id", "team_name", "venue", "venue_win_pct_last_n")


@register("games_played", FEAT_SQL + "select game_id, team_name, games_played, games_played_asof from feat")
def games_played(spark, sf_dir):
    """Lagged-id count over the whole participant (as-run) and previous games (as-of)."""
    return features(spark, sf_dir).select("game_id", "team_name", "games_played", "games_played_asof")


SEASON = ["season_win_pct", "season_avg_pts", "season_avg_pts_allowed"]


@register("season_trends", FEAT_SQL + "select game_id, team_name, season_id, " + ", ".join(SEASON) +
          " from feat", doubles=SEASON)
def season_trends(spark, sf_dir):
    """W5 as-run: mean of all but the season's last game, on every row."""
    return features(spark, sf_dir).select("game_id", "team_name", "season_id", *SEASON)


@register("season_trends_asof", FEAT_SQL + "select game_id, team_name, season_id, " +
          ", ".join(f"{c}_asof as {c}" for c in SEASON) + " from feat", doubles=SEASON)
def season_trends_asof(spark, sf_dir):
    """W5 leak-free: mean of the earlier games of the season only."""
    f = features(spark, sf_dir)
    return f.select("game_id", "team_name", "season_id", *[f[f"{c}_asof"].alias(c) for c in SEASON])


@register("game_number", FEAT_SQL + "select game_id, team_name, game_number_in_season from feat",
          doubles=["game_number_in_season"])
def game_number(spark, sf_dir):
    """Average rank of the date within (participant, season)."""
    return features(spark, sf_dir).select("game_id", "team_name", "game_number_in_season")


@register("rest_days", FEAT_SQL + "select game_id, team_name, rest_days from feat")
def rest_days(spark, sf_dir):
    """W7 + P16: days since the previous game, 2 on a participant's first game."""
    return features(spark, sf_dir, whole_group=False).select("game_id", "team_name", "rest_days")


@register("rest_days_in_season",
          "with " + cte_team_games() + " select game_id, team_name, cast(coalesce(date_diff('day', lag(game_date) "
          "over (partition by team_name, season_id order by game_date, game_id), game_date), 2) as int) as "
          "rest_days_in_season from tg")
def rest_days_in_season(spark, sf_dir):
    """W7 with the Q3 option: the default also applies to each season's first game."""
    return features(spark, sf_dir, whole_group=False).select("game_id", "team_name", "rest_days_in_season")


@register("features_final", FEAT_SQL + "select " + ", ".join(FINAL) + " from feat where games_played >= 3",
          doubles=FINAL_DOUBLES)
def features_final(spark, sf_dir):
    """P11 + P12 as-run: the model feature table."""
    return WN.final_features(features(spark, sf_dir), CFG)


@register("features_final_asof",
          FEAT_SQL + "select " + ", ".join(
              f"{c}_asof as {c}" if c in SEASON else c for c in FINAL) +
          " from feat where games_played_asof >= 3", doubles=FINAL_DOUBLES)
def features_final_asof(spark, sf_dir):
    """P11 + P12 leak-free: early rows dropped, season means from earlier games."""
    cfg = FeatureConfig(as_of=True)
    return WN.final_features(features(spark, sf_dir, cfg), cfg)


TG_COLS = ["game_id", "game_date", "season_id", "team_name", "team_abbrev", "venue", "pts_for",
           "pts_against", "win", "fg_pct", "fg3_pct", "ft_pct", "rebounds", "assists", "steals",
           "blocks", "turnovers", "opponent", "opp_abbrev", "point_diff", "win_numeric", "is_home"]


@register("team_games", "with " + cte_team_games() + " select " + ", ".join(TG_COLS) + " from tg",
          doubles=["fg_pct", "fg3_pct", "ft_pct", "win_numeric"])
def team_games(spark, sf_dir):
    """P3 + P4 + U1: wide games -> one row per participant, one scan."""
    return team_rows(spark, sf_dir).select(*TG_COLS)


@register("games_clean",
          "with " + derive.cte_games() + " select cast(game_id as varchar) as game_id, game_date, "
          "trim(team_name_home) as team_name_home, trim(team_name_away) as team_name_away, "
          "pts_home > pts_away as home_win, pts_away > pts_home as away_win, "
          "pts_home - pts_away as point_diff from games")
def games_clean(spark, sf_dir):
    """P1 + P2 + X1 + X12: cleaned wide games with win flags and point difference."""
    g = G.clean_games(derive.games(spark, sf_dir))
    return g.select("game_id", "game_date", "team_name_home", "team_name_away",
                    "home_win", "away_win", "point_diff")


def QUERIES_FLAGSHIP(spark, sf_dir):  # noqa: N802 - entry point used by __spark_entry__
    from lineup.plans.catalog import QUERIES
    return QUERIES["features_final"](spark, sf_dir)
