"""Descriptive queries over the feature and game tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators import analytics as A
from lineup.plans import derive
from lineup.plans.catalog import register
from lineup.plans.q_features import FEAT_SQL, FINAL, features_final

FF = FEAT_SQL + ", ff as (select " + ", ".join(FINAL) + " from feat where games_played >= 3) "


def ff(spark, sf_dir):
    """The as-run feature table (unrounded) that the notebook analyses read."""
    return features_final(spark, sf_dir)


@register("dataset_profile", FF + "select count(*) as rows, min(game_date) as min_date, max(game_date) as "
          "max_date, count(distinct team_name) as unique_teams, count(distinct game_id) as unique_games from ff")
def dataset_profile(spark, sf_dir):
    """A1 + S13: rows, date range, distinct participants and games of the feature table."""
    return A.dataset_profile(ff(spark, sf_dir))


@register("win_rate_split", FF + "select avg(cast(target_win as double)) as win_rate, avg(case when is_home "
          "then cast(target_win as double) end) as home_win_rate, avg(case when not is_home then "
          "cast(target_win as double) end) as away_win_rate from ff",
          doubles=["win_rate", "home_win_rate", "away_win_rate"])
def win_rate_split(spark, sf_dir):
    """A2: overall, home and away win rate."""
    return A.win_rate_split(ff(spark, sf_dir))


TS_SQL = (FF + ", ts0 as (select team_name, count(target_win) as games_played, round_even(avg(cast(target_win "
          "as double)), 3) as win_rate, " + ", ".join(f"round_even(avg({s}), 3) as {d}" for s, d in A.TEAM_STATS) +
          ", round_even(avg(cast(is_home as double)), 3) as home_game_pct from ff group by team_name), ts as "
          "(select *, season_avg_pts - season_avg_pts_allowed as season_point_diff, recent_avg_pts - "
          "recent_avg_pts_allowed as recent_point_diff from ts0) ")
TS_DOUBLES = ["win_rate"] + [d for _, d in A.TEAM_STATS] + ["home_game_pct", "season_point_diff",
                                                            "recent_point_diff"]


def ts(spark, sf_dir):
    return A.team_stats(ff(spark, sf_dir))


@register("team_performance", TS_SQL + "select * from ts", doubles=TS_DOUBLES)
def team_performance(spark, sf_dir):
    """A3 + X16: per-participant count and rounded means, differences after rounding."""
    return ts(spark, sf_dir)


LEAGUE = ["avg_win_rate", "avg_points", "avg_points_allowed", "avg_point_diff", "min_win_rate", "max_win_rate",
          "min_points", "max_points", "min_point_diff", "max_point_diff"]


@register("league_summary", TS_SQL + "select avg(win_rate) as avg_win_rate, avg(season_avg_pts) as avg_points, "
          "avg(season_avg_pts_allowed) as avg_points_allowed, avg(season_point_diff) as avg_point_diff, "
          "min(win_rate) as min_win_rate, max(win_rate) as max_win_rate, min(season_avg_pts) as min_points, "
          "max(season_avg_pts) as max_points, min(season_point_diff) as min_point_diff, max(season_point_diff) "
          "as max_point_diff from ts", doubles=LEAGUE)
def league_summary(spark, sf_dir):
    """A4: league averages and ranges over the per-participant table."""
    return A.league_summary(ts(spark, sf_dir))


TREND = ("case when recent_win_pct > season_win_pct + 0.1 then 'improving' when recent_win_pct < "
         "season_win_pct - 0.1 then 'declining' else 'steady' end")


@register("team_extremes", TS_SQL + "select arg_min(team_name, (-win_rate, team_name)) as best_team, "
          "arg_min(team_name, (win_rate, team_name)) as worst_team, arg_min(team_name, (-season_avg_pts, "
          "team_name)) as top_scoring_team, arg_min(team_name, (season_avg_pts_allowed, team_name)) as "
          "best_defense_team, arg_min(team_name, (abs(season_point_diff), team_name)) as most_balanced_team, "
          "count(*) filter (where " + TREND + " = 'improving') as n_improving, count(*) filter (where " + TREND +
          " = 'declining') as n_declining, avg(season_point_diff) as avg_point_diff from ts",
          doubles=["avg_point_diff"])
def team_extremes(spark, sf_dir):
    """A5 + X15: best, worst, top scoring, best defence, most balanced; trend counts."""
    return A.team_extremes(ts(spark, sf_dir))


@register("team_rank_classes", TS_SQL + "select team_name, win_rate, season_point_diff, case when win_rate < 0.4 "
          "then 'red' when win_rate < 0.6 then 'orange' else 'green' end as win_rate_class, case when "
          "season_point_diff < -5 then 'red' when season_point_diff < 0 then 'orange' when season_point_diff < 5 "
          "then 'lightgreen' else 'green' end as diff_class, " + TREND + " as form_trend from ts",
          doubles=["win_rate", "season_point_diff"])
def team_rank_classes(spark, sf_dir):
    """T7 + X14 + X15: ranked participants with colour classes and form trend."""
    return A.team_rank_classes(ts(spark, sf_dir))


MONTH_SQL = TS_SQL.replace("ts0 as (select team_name,", "ts0 as (select team_name, cast(date_trunc('month', "
                           "game_date) as date) as month,").replace("group by team_name)", "group by all)")


@register("team_outliers", MONTH_SQL + "select * from ts where season_point_diff > 8 or season_point_diff < -8 "
          "or win_rate > 0.7 or win_rate < 0.3", doubles=TS_DOUBLES)
def team_outliers(spark, sf_dir):
    """P20: participants with extreme difference or win rate, by month (over whole seasons
    the derived games have none)."""
    monthly = ff(spark, sf_dir).withColumn("month", F.trunc("game_date", "month"))
    return A.team_outliers(A.team_stats(monthly, ("team_name", "month")))


RANK_LISTS = [("win_rate", "desc"), ("season_avg_pts", "desc"), ("season_avg_pts_allowed", "asc"),
              ("season_point_diff", "desc")]


@register("team_rankings", TS_SQL + "select * from (" + " union all ".join(
    f"select team_name, '{c}' as list, {c} as value, cast(row_number() over (order by {c} {o}, team_name) as int) "
    f"as rank from ts" for c, o in RANK_LISTS) + ") where rank <= 10", doubles=["value"])
def team_rankings(spark, sf_dir):
    """Ten best by win rate, points, fewest points allowed and difference (limits are the feature)."""
    return A.team_rankings(ts(spark, sf_dir), 10)


@register("top_teams", TS_SQL + "select * from ts order by win_rate desc, team_name limit 10", doubles=TS_DOUBLES)
def top_teams(spark, sf_dir):
    """Top 10 participants by win rate (limit is the feature)."""
    return A.top_n(ts(spark, sf_dir), "win_rate", 10)


@register("games_per_day", "with " + derive.cte_games() + ", d as (select game_date, count(*) as n from games "
          "group by game_date) select count(*) as days, avg(n) as avg_games_per_day, max(n) as "
          "max_games_per_day from d", doubles=["avg_games_per_day"])
def games_per_day(spark, sf_dir):
    """Mean and max games per day."""
    return A.games_per_day(derive.games(spark, sf_dir))


@register("monthly_scoring", "with " + derive.cte_games() + " select cast(date_trunc('month', game_date) as date) "
          "as month, round_even(avg(pts_home + pts_away), 1) as avg_total_points, round_even(avg(pts_home), 1) as "
          "avg_home_points, round_even(avg(pts_away), 1) as avg_away_points, count(*) as games from games "
          "group by 1", doubles=["avg_total_points", "avg_home_points", "avg_away_points"])
def monthly_scoring(spark, sf_dir):
    """A7 + X6: monthly mean points."""
    return A.monthly_scoring(derive.games(spark, sf_dir))


@register("home_advantage", "with " + derive.cte_games() + " select avg(case when pts_home > pts_away then 1e0 "
          "else 0e0 end) as home_win_share, avg(pts_home + pts_away) as avg_total_points, avg(pts_home) as "
          "avg_home_points, avg(pts_away) as avg_away_points, avg(pts_home - pts_away) as avg_home_margin "
          "from games", doubles=["home_win_share", "avg_total_points", "avg_home_points", "avg_away_points",
                                 "avg_home_margin"])
def home_advantage(spark, sf_dir):
    """Home-win share and average totals."""
    return A.home_advantage(derive.games(spark, sf_dir))


CORR_COLS = [c for c in FINAL if c not in ("game_id", "game_date", "team_name", "opponent", "venue",
                                           "target_win")]
CORR_SQL = (FF + ", corr_t as (" + " union all ".join(
    f"select '{c}' as feature, corr(cast({c} as double), cast(target_win as double)) as correlation from ff"
    for c in CORR_COLS) + ") ")


@register("target_correlation", CORR_SQL + "select * from corr_t", doubles=["correlation"])
def target_correlation(spark, sf_dir):
    """A9 + P13 + T4: correlation of every numeric feature with the target (one pass)."""
    return A.target_correlation(ff(spark, sf_dir), exclude=("game_id",))


@register("correlation_ranked", CORR_SQL + "select *, cast(row_number() over (order by abs(correlation) desc nulls "
          "last, feature) as int) as rank, case when row_number() over (order by abs(correlation) desc nulls last, "
          "feature) <= 5 then 'top' when row_number() over (order by abs(correlation) desc nulls last, feature) > "
          "count(*) over () - 3 then 'bottom' else 'middle' end as part from corr_t", doubles=["correlation"])
def correlation_ranked(spark, sf_dir):
    """T4: features by falling |correlation|; top 5 and bottom 3 of the 12 here (15 and 10 by default)."""
    return A.ranked_correlation(A.target_correlation(ff(spark, sf_dir), exclude=("game_id",)), 5, 3)


MATRIX_COLS = sorted([*CORR_COLS, "target_win"])
MATRIX_SQL = (FF + ", m as (select unnest([" + ", ".join(
    f"{{'feature_a': '{a}', 'feature_b': '{b}', 'correlation': corr(cast({a} as double), cast({b} as double))}}"
    for a in MATRIX_COLS for b in MATRIX_COLS) + "], recursive := true) from ff) ")


@register("correlation_matrix", MATRIX_SQL + "select * from m", doubles=["correlation"])
def correlation_matrix(spark, sf_dir):
    """The full correlation matrix with the target, one pass."""
    return A.correlation_matrix(ff(spark, sf_dir))


@register("correlation_matrix_top", MATRIX_SQL + ", t as (select feature_a as f from m where feature_b = "
          "'target_win' and feature_a <> 'target_win' order by abs(correlation) desc, feature_a limit 10), n as "
          "(select f from t union all select 'target_win') select m.* from m where feature_a in (select f from n) "
          "and feature_b in (select f from n)", doubles=["correlation"])
def correlation_matrix_top(spark, sf_dir):
    """The matrix of the ten features most correlated with the target, and the target."""
    return A.top_correlation_matrix(A.correlation_matrix(ff(spark, sf_dir)))


@register("correlation_summary", CORR_SQL + "select count(*) filter (where correlation > 0.1) as n_positive, "
          "count(*) filter (where correlation < -0.1) as n_negative, arg_max(feature, correlation) as "
          "strongest_positive, arg_min(feature, correlation) as strongest_negative, max(correlation) as "
          "max_correlation, min(correlation) as min_correlation from corr_t",
          doubles=["max_correlation", "min_correlation"])
def correlation_summary(spark, sf_dir):
    """A10: counts of notable correlations and the strongest of each sign."""
    return A.correlation_summary(A.target_correlation(ff(spark, sf_dir), exclude=("game_id",)))


@register("missing_values", FF + "select * from (" + " union all ".join(
    f"select '{c}' as column_name, cast(count(*) filter (where {c} is null) as bigint) as missing from ff"
    for c in FINAL) + ")")
def missing_values(spark, sf_dir):
    """NULL count of every column of the feature table."""
    return A.missing_values(ff(spark, sf_dir))
