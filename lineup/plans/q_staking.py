"""Queries over stakes and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.config import StakeConfig
from lineup.functions import odds as O
from lineup.operators import staking as ST
from lineup.operators.performance import daily_pnl
from lineup.plans import derive
from lineup.plans.catalog import register
from lineup.plans.q_markets import CTE_EDGES, edges

BANKROLL = 10000.0
# One stricter threshold so recommended and skipped bets are both common.
CFG = StakeConfig(min_edge=0.10)

KELLY_SQL = ("case when {p} <= 0 or {p} >= 1 or {o} <= 1 then 0e0 else greatest(0e0, (({o} - 1) * {p} - "
             "(1 - {p})) / ({o} - 1)) end")


def _kelly(p, o):
    return KELLY_SQL.format(p=p, o=o)


def _stake(p, o, k=0.5, m=0.1, bank=BANKROLL):
    return f"least({bank}e0 * ({_kelly(p, o)}) * {k}e0, {bank}e0 * {m}e0)"


@register("kelly_stakes",
          "with " + CTE_EDGES + " select game_id, " + _kelly("home_prob", "home_odds") + " as home_kelly, " +
          _kelly("away_prob", "away_odds") + " as away_kelly, " + _stake("home_prob", "home_odds") +
          " as home_stake, " + _stake("away_prob", "away_odds") + " as away_stake from preds",
          doubles=["home_kelly", "away_kelly", "home_stake", "away_stake"])
def kelly_stakes(spark, sf_dir):
    """F8 + F9: full Kelly fraction and half-Kelly stake (10 % cap) per side, bankroll 10,000."""
    e = edges(spark, sf_dir)
    return e.select(
        "game_id",
        O.kelly_fraction("home_prob", "home_odds").alias("home_kelly"),
        O.kelly_fraction("away_prob", "away_odds").alias("away_kelly"),
        O.fractional_stake("home_prob", "home_odds", BANKROLL).alias("home_stake"),
        O.fractional_stake("away_prob", "away_odds", BANKROLL).alias("away_stake"))


BET_COLS = ["game_id", "game_date", "best_bet_team", "recommended_bet", "stake_amount", "expected_value",
            "kelly_fraction"]
STAKE_B = _stake("best_bet_prob", "best_bet_odds")
CTE_BETS = (CTE_EDGES + ", bets as (select *, coalesce(best_bet_edge >= 0.1e0, false) as recommended_bet, "
            "case when coalesce(best_bet_edge >= 0.1e0, false) then " + STAKE_B + " else 0e0 end as stake_amount, "
            "case when coalesce(best_bet_edge >= 0.1e0, false) then (" + STAKE_B + ") * (best_bet_prob * "
            "(best_bet_odds - 1) - (1 - best_bet_prob)) else 0e0 end as expected_value, "
            "case when coalesce(best_bet_edge >= 0.1e0, false) then " + _kelly("best_bet_prob", "best_bet_odds") +
            " else 0e0 end as kelly_fraction from edges)")


def bets(spark, sf_dir):
    return ST.bet_sizes(edges(spark, sf_dir), BANKROLL, CFG)


@register("bet_sizes", "with " + CTE_BETS + " select " + ", ".join(BET_COLS) + " from bets",
          doubles=["stake_amount", "expected_value", "kelly_fraction"])
def bet_sizes(spark, sf_dir):
    """F10 + F11 + T2: recommendation flag, stake, expected value, Kelly fraction; best EV first."""
    return ST.rank_bets(bets(spark, sf_dir)).select(*BET_COLS)


RISK_COLS = ["mean_return", "std_return", "prob_profit", "percentile_5", "percentile_95", "max_loss", "max_gain"]


@register("risk_distribution",
          "with " + derive.cte_bets() + ", d as (select bet_date, sum(profit_loss) as total from bets group by 1) "
          "select cast(isodow(bet_date) as int) as weekday, count(*) as n_days, avg(total) as mean_return, "
          "stddev_pop(total) as std_return, avg(case when total > 0 then 1e0 else 0e0 end) as prob_profit, "
          "quantile_cont(total, 0.05) as percentile_5, quantile_cont(total, 0.95) as percentile_95, "
          "min(total) as max_loss, max(total) as max_gain from d group by 1", doubles=RISK_COLS)
def risk_distribution(spark, sf_dir):
    """Distribution of the days' real profit and loss, per weekday (1 = Monday)."""
    days = daily_pnl(derive.bets(spark, sf_dir)).withColumn("weekday", (F.weekday("day") + 1).cast("int"))
    return ST.return_distribution(days, "daily_pnl", ("weekday",))


@register("risk_closed_form",
          "with " + CTE_BETS + " select game_date, sum(stake_amount * (best_bet_prob * (best_bet_odds - 1) - "
          "(1 - best_bet_prob))) as mean_return_exact, sqrt(sum(stake_amount * stake_amount * best_bet_odds * "
          "best_bet_odds * best_bet_prob * (1 - best_bet_prob))) as std_return_exact, count(*) as n_bets "
          "from bets where recommended_bet group by game_date",
          doubles=["mean_return_exact", "std_return_exact"])
def risk_closed_form(spark, sf_dir):
    """Exact mean and std of each day's total return."""
    return ST.risk_closed_form(bets(spark, sf_dir), ("game_date",))


@register("daily_bet_report",
          "with " + CTE_BETS + " select game_date, count(*) as total_games, cast(sum(cast(recommended_bet as int)) "
          "as bigint) as recommended_bets, sum(stake_amount) as total_stake, sum(expected_value) as expected_value "
          "from bets group by game_date", doubles=["total_stake", "expected_value"])
def daily_bet_report(spark, sf_dir):
    """Games, recommended bets, total stake and expected value per day."""
    return ST.daily_totals(bets(spark, sf_dir), ("game_date",)).withColumn(
        "recommended_bets", F.col("recommended_bets").cast("bigint"))


REPORT = ["game_date", "rank", "game_id", "home_team", "away_team", "best_bet_team", "best_bet_odds",
          "best_bet_edge", "recommended_bet", "stake_amount", "expected_value"]
REPORT_DOUBLES = ["best_bet_odds", "best_bet_edge", "stake_amount", "expected_value"]


@register("daily_report",
          "with " + CTE_BETS + " select " + ", ".join(c for c in REPORT if c != "rank") + ", cast(row_number() "
          "over (partition by game_date order by expected_value desc, game_id) as int) as rank from bets",
          doubles=REPORT_DOUBLES)
def daily_report(spark, sf_dir):
    """Every game of every day as a report record."""
    return ST.daily_report(bets(spark, sf_dir)).select(*REPORT)
