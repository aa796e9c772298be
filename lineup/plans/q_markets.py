"""Queries over predictions and prices (F1-F7, J-1, J-2, J-3, J-4, A23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.constants import TEAM_ABBREVIATIONS
from lineup.functions import odds as O
from lineup.functions.calendar import local_game_date
from lineup.operators import games as G
from lineup.operators import markets as M
from lineup.plans import derive
from lineup.plans.catalog import register
from lineup.plans.oracle import cte_team_games
from lineup.session import shared_dir
from lineup.sources.odds_json import flatten_odds

EDGE_COLS = ["game_id", "home_implied_prob", "away_implied_prob", "home_edge", "away_edge",
             "best_bet_team", "best_bet_edge", "best_bet_prob", "best_bet_odds"]
EDGE_DOUBLES = [c for c in EDGE_COLS if c not in ("game_id", "best_bet_team")]

CTE_EDGES = (
    derive.cte_predictions() + ", e1 as (select *, case when home_odds > 0 then 1e0 / home_odds end "
    "as home_implied_prob, case when away_odds > 0 then 1e0 / away_odds end as away_implied_prob from preds), "
    "e2 as (select *, home_prob - home_implied_prob as home_edge, away_prob - away_implied_prob as away_edge "
    "from e1), edges as (select *, case when coalesce(home_edge > away_edge, false) then home_team "
    "else away_team end as best_bet_team, case when home_edge is not null and away_edge is not null "
    "then greatest(home_edge, away_edge) end as best_bet_edge, case when coalesce(home_edge > away_edge, "
    "false) then home_prob else away_prob end as best_bet_prob, case when coalesce(home_edge > away_edge, "
    "false) then home_odds else away_odds end as best_bet_odds from e2)"
)


def edges(spark, sf_dir):
    return M.betting_edges(derive.predictions(spark, sf_dir))


@register("betting_edges", "with " + CTE_EDGES + " select " + ", ".join(EDGE_COLS) + " from edges",
          doubles=EDGE_DOUBLES)
def betting_edges(spark, sf_dir):
    """F2 + F5 + F6 + F7: implied probabilities, edges and the better side."""
    return edges(spark, sf_dir).select(*EDGE_COLS)


# Team-level scores to re-pair: p from the game id and side.
TEAM_P = "((game_id * 7919 + case when is_home then 13 else 0 end) % 1000) / 1000e0"
PAIR_COLS = ["game_id", "game_date", "home_team", "away_team", "home_prob", "away_prob",
             "predicted_winner", "confidence"]


@register("pair_normalize",
          "with " + cte_team_games() + ", s as (select game_id, game_date, team_abbrev as team, is_home, "
          + TEAM_P + " as p from tg), g as (select game_id, any_value(game_date) as game_date, "
          "max(case when is_home then team end) as home_team, max(case when not is_home then team end) "
          "as away_team, max(case when is_home then p end) as ph, max(case when not is_home then p end) as pa "
          "from s group by game_id), n as (select *, case when ph + pa > 0 then ph / (ph + pa) else ph end "
          "as home_prob, case when ph + pa > 0 then pa / (ph + pa) else pa end as away_prob from g) "
          "select game_id, game_date, home_team, away_team, home_prob, away_prob, case when home_prob > "
          "away_prob then home_team else away_team end as predicted_winner, greatest(home_prob, away_prob) "
          "as confidence from n", doubles=["home_prob", "away_prob", "confidence"])
def pair_normalize(spark, sf_dir):
    """J-4 + F3 + F4: two scored participant rows -> one normalised game row."""
    tg = G.team_games(derive.games(spark, sf_dir))
    s = tg.select("game_id", "game_date", F.col("team_abbrev").alias("team"), "is_home",
                  F.expr(TEAM_P).alias("p"))
    return M.pair_games(s).select(*PAIR_COLS)


AMERICAN = "cast(((o_orderkey * 37) % 601) - 300 as double)"


@register("implied_prob_american",
          "select o_orderkey as game_id, " + AMERICAN + " as price, case when " + AMERICAN + " > 0 then "
          "100e0 / (" + AMERICAN + " + 100) end as prob_as_run, case when " + AMERICAN + " > 0 then 100e0 / ("
          + AMERICAN + " + 100) when " + AMERICAN + " < 0 then -" + AMERICAN + " / (-" + AMERICAN +
          " + 100) end as prob_fixed from orders", doubles=["price", "prob_as_run", "prob_fixed"])
def implied_prob_american(spark, sf_dir):
    """American price -> probability; as-run drops favourites (Q8), fixed converts both signs."""
    o = derive.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"),
                                                    F.expr(AMERICAN).alias("price"))
    return o.select("game_id", "price", O.american_to_prob("price").alias("prob_as_run"),
                    O.american_to_prob("price", fixed=True).alias("prob_fixed"))


CONS_KEYS = ["game_date", "home_team", "away_team"]


def _abbr_sql(col: str) -> str:
    cases = " ".join(f"when '{n}' then '{a}'" for n, a in TEAM_ABBREVIATIONS)
    return f"coalesce(case {col} {cases} end, upper(substr({col}, 1, 3)))"


def _decimal_sql(col: str) -> str:
    return f"case when {col} > 0 then 1 + {col} / 100e0 when {col} < 0 then 1 + 100e0 / -{col} end"


# Prices are averaged as decimal ones; a game belongs to its local day (UTC less five hours).
CTE_CONSENSUS = (
    derive.cte_odds_rows() + ", cons as (select cast(commence_time - interval 5 hour as date) as game_date, "
    + _abbr_sql("home_team") + " as home_team, " + _abbr_sql("away_team") + " as away_team, avg("
    + _decimal_sql("home_odds") + ") as home_odds, avg(" + _decimal_sql("away_odds") + ") as away_odds, "
    "count(*) as n_books from odds_rows where commence_time is not null group by all)"
)


def consensus(spark, sf_dir):
    rows = flatten_odds(derive.odds_documents(spark, sf_dir))
    rows = M.decimal_quotes(rows).withColumn("game_date", local_game_date("commence_time"))
    rows = rows.where(F.col("game_date").isNotNull())
    rows = M.normalize_team(rows, "home_team", "_h")
    rows = M.normalize_team(rows, "away_team", "_a")
    rows = rows.drop("home_team", "away_team").withColumnsRenamed({"_h": "home_team", "_a": "away_team"})
    return M.odds_consensus(rows, CONS_KEYS)


@register("odds_consensus", "with " + CTE_CONSENSUS + " select * from cons",
          doubles=["home_odds", "away_odds"])
def odds_consensus(spark, sf_dir):
    """A23 + J4 + J-2 + X7: mean decimal price per side over bookmakers for each matchup of a local day."""
    return consensus(spark, sf_dir)


SCHED_COLS = ["game_id", "game_date", "home_team", "away_team", "home_odds", "away_odds"]


@register("games_join_odds",
          "with " + CTE_CONSENSUS + ", " + derive.cte_games() + ", sched as (select game_id, game_date, "
          "team_abbreviation_home as home_team, team_abbreviation_away as away_team, case when game_id % 3 = 0 "
          "then 1.9e0 end as home_odds, case when game_id % 3 = 0 then 1.95e0 end as away_odds from games) "
          "select s.game_id, s.game_date, s.home_team, s.away_team, coalesce(c.home_odds, s.home_odds) as "
          "home_odds, coalesce(c.away_odds, s.away_odds) as away_odds from sched s left join cons c "
          "on s.game_date = c.game_date and s.home_team = c.home_team and s.away_team = c.away_team",
          doubles=["home_odds", "away_odds"])
def games_join_odds(spark, sf_dir):
    """J-1 (Q7 fixed): schedule left-joined to consensus odds, schedule prices kept as fallback."""
    g = derive.games(spark, sf_dir)
    sched = g.select("game_id", "game_date", F.col("team_abbreviation_home").alias("home_team"),
                     F.col("team_abbreviation_away").alias("away_team"),
                     F.expr("case when game_id % 3 = 0 then 1.9e0 end").alias("home_odds"),
                     F.expr("case when game_id % 3 = 0 then 1.95e0 end").alias("away_odds"))
    return M.join_odds(sched, consensus(spark, sf_dir), CONS_KEYS).select(*SCHED_COLS)


@register("team_normalize",
          "select c_custkey, c_name, coalesce(case c_name " + " ".join(
              f"when '{n}' then '{a}'" for n, a in TEAM_ABBREVIATIONS)
          + " end, upper(substr(c_name, 1, 3))) as team_abbr from (select c_custkey, case when c_custkey % 2 = 0 "
          "then " + derive.team_name_sql("cast(c_custkey % 30 as int)", "duckdb") + " else c_name end as c_name "
          "from customer)")
def team_normalize(spark, sf_dir):
    """J-2: names -> abbreviations through the 30-row dimension; others -> first 3 letters upper."""
    c = derive.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 2 = 0 then " +
        derive.team_name_sql("cast(c_custkey % 30 as int)", "spark") + " else c_name end as c_name")
    return M.normalize_team(c, "c_name").select("c_custkey", "c_name", "team_abbr")


PROFILE_COLS = ["game_id", "team", "is_home", "avg_pts_last_10", "avg_pts_allowed_last_10",
                "avg_point_diff_last_10", "win_pct_last_10", "win_pct_last_5", "avg_point_diff_last_5",
                "season_win_pct", "season_avg_pts", "season_avg_pts_allowed"]


def _profile_sql() -> str:
    from lineup.constants import TEAM_PROFILES
    vals = ", ".join(f"('{t}', {p}e0, {a}e0, {w}e0)" for t, p, a, w in TEAM_PROFILES)
    return (
        "with " + cte_team_games() + ", prof(pt, pts, pa, wp) as (values " + vals + "), j as (select "
        "tg.game_id, tg.team_abbrev as team, tg.is_home, coalesce(pts, 112e0) as pts, coalesce(pa, 112e0) as pa, "
        "coalesce(wp, 0.5e0) as wp, case when tg.is_home then 2.5e0 else -2.5e0 end as boost, case when "
        "tg.is_home then 0.05e0 else -0.05e0 end as shift from tg left join prof on tg.team_abbrev = prof.pt) "
        "select game_id, team, is_home, pts + boost as avg_pts_last_10, pa - boost * 0.5e0 as "
        "avg_pts_allowed_last_10, (pts - pa) + boost as avg_point_diff_last_10, least(0.95e0, greatest(0.05e0, "
        "wp + shift)) as win_pct_last_10, least(0.95e0, greatest(0.05e0, wp + shift)) as win_pct_last_5, "
        "(pts - pa) + boost as avg_point_diff_last_5, wp as season_win_pct, pts as season_avg_pts, "
        "pa as season_avg_pts_allowed from j")


@register("team_profile_features", _profile_sql(), doubles=PROFILE_COLS[3:])
def team_profile_features(spark, sf_dir):
    """J-3 + F13: profile lookup with league-average default and home adjustments."""
    tg = G.team_games(derive.games(spark, sf_dir)).select(
        "game_id", F.col("team_abbrev").alias("team"), "is_home")
    return M.team_profile_features(tg).select(*PROFILE_COLS)


#: Snapshots of the feed: hour of the game's day when it was seen, and price movement.  The second falls
#: before, on or after the start, the third always after it.
CLOSING_SNAPSHOTS = [("12", 0), ("(16 + (o_orderkey * 7) % 12)", 29), ("30", 58)]


def _seen_sql(hour: str, dialect: str) -> str:
    day = "cast(cast(o_orderdate as date) as timestamp)"
    return f"timestampadd(HOUR, {hour}, {day})" if dialect == "spark" else f"{day} + to_hours(cast({hour} as integer))"


def _closing_sql() -> str:
    parts = " union all ".join(
        "select * from (with " + derive.cte_odds_rows(move) + f" select r.game_id, bookmaker, {_seen_sql(hour, 'duckdb')} as "
        "seen, " + _decimal_sql("home_odds") + " as ho, " + _decimal_sql("away_odds") + " as ao from odds_rows r join orders "
        "on r.game_id = cast(o_orderkey as varchar))" for hour, move in CLOSING_SNAPSHOTS)
    tip = "cast(cast(o_orderdate as date) as timestamp) + to_hours(cast(16 + o_orderkey % 12 as integer))"
    return ("with q as (" + parts + "), s as (select cast(o_orderkey as varchar) as game_id, " + tip + " as commence_time "
            "from orders), p as (select distinct game_id, bookmaker from q), l as (select s.game_id, p.bookmaker, "
            "q.seen, q.ho, q.ao from s join p using (game_id) asof left join q on s.game_id = q.game_id and p.bookmaker "
            "= q.bookmaker and s.commence_time > q.seen), g as (select game_id, avg(ho) as home_odds, avg(ao) as "
            "away_odds, count(seen) as n_books, max(seen) as last_seen from l group by 1) select s.game_id, "
            "s.commence_time, home_odds, away_odds, n_books, last_seen from s left join g using (game_id)")


@register("closing_odds_join", _closing_sql(), doubles=["home_odds", "away_odds"])
def closing_odds_join(spark, sf_dir):
    """J-1 as of tip-off: of three snapshots of every game's feed the last quote of each bookmaker before
    the start, averaged per game and joined to the schedule.  The join reads the quotes several times: they
    are taken from the documents once and written."""
    quotes = None
    for hour, move in CLOSING_SNAPSHOTS:
        docs = derive.documents(spark, sf_dir, f"{_seen_sql(hour, 'spark')} as snapshot_ts", f"{derive.odds_doc_sql(move)} as doc")
        rows = M.decimal_quotes(flatten_odds(docs, keep=("snapshot_ts",))).select(
            "game_id", "bookmaker", "snapshot_ts", "home_odds", "away_odds")
        quotes = rows if quotes is None else quotes.unionByName(rows)
    path = shared_dir(spark, "closing_quotes")
    quotes.write.parquet(path)
    schedule = derive.read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) as game_id",
                                                               f"{derive.COMMENCE_TS} as commence_time")
    out = M.closing_odds(schedule, spark.read.parquet(path))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("commence_time", "last_seen")})
