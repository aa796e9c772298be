"""Stake sizing and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineup.config import StakeConfig
from lineup.functions import odds as O
from lineup.operators.sequence import ranked

REQUIRED = ("best_bet_prob", "best_bet_odds", "best_bet_edge")


def validate(df: DataFrame, required=REQUIRED) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def bet_sizes(edges: DataFrame, bankroll, cfg: StakeConfig = StakeConfig()) -> DataFrame:
    """recommend a bet when its best edge reaches ``min_edge`` (a NULL
    edge is not recommended); stake, expected value and Kelly fraction are 0
    otherwise.  Every input row is kept; the flag stays true even when the
    Kelly stake is 0.  ``bankroll`` is a number or a column (per-account)."""
    validate(edges)
    rec = F.coalesce(F.col("best_bet_edge") >= F.lit(cfg.min_edge), F.lit(False))
    p, o = F.col("best_bet_prob"), F.col("best_bet_odds")
    stake = O.fractional_stake(p, o, bankroll, cfg.kelly_fraction, cfg.max_bet_size)
    zero = F.lit(0.0)
    return edges.withColumns({
        "recommended_bet": rec,
        "stake_amount": F.when(rec, stake).otherwise(zero),
        "expected_value": F.when(rec, O.expected_value(stake, p, o)).otherwise(zero),
        "kelly_fraction": F.when(rec, O.kelly_fraction(p, o)).otherwise(zero),
    })


def rank_bets(bets: DataFrame, group=("game_date",), tie: str = "game_id") -> DataFrame:
    """A day's bets with the highest expected value first, ``rank`` from 1 (a total order with
    ``tie``).  The rank comes from counts of value ranges, so a day of very many bets, or all bets
    without a date, are spread over tasks, for the ranking and for the sort by (day, rank)."""
    return ranked(bets, list(group), "expected_value", tie).repartitionByRange(*group, "rank").sortWithinPartitions(
        *group, "rank")


def return_distribution(totals: DataFrame, value: str, group=()) -> DataFrame:
    """A22 on real totals (a day's profit and loss, say): mean, population std,
    P(profit), 5th and 95th percentile (linear), min and max of ``value`` per group."""
    x = F.col(value)
    return totals.where(x.isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(x).alias("mean_return"), F.stddev_pop(x).alias("std_return"),
        F.avg((x > 0).cast("double")).alias("prob_profit"), F.percentile(x, F.lit(0.05)).alias("percentile_5"),
        F.percentile(x, F.lit(0.95)).alias("percentile_95"), F.min(x).alias("max_loss"), F.max(x).alias("max_gain"))


def risk_closed_form(bets: DataFrame, group=("game_date",)) -> DataFrame:
    """Exact mean and std of the total return of independent bets:
    mean = sum (p win + q loss), var = sum (win - loss)^2 p q (F14)."""
    rec = bets.where(F.col("recommended_bet"))
    s, p, o = F.col("stake_amount"), F.col("best_bet_prob"), F.col("best_bet_odds")
    win, loss = O.bet_return(s, o, F.lit(True)), O.bet_return(s, o, F.lit(False))
    return rec.groupBy(*group).agg(
        F.sum(p * win + (1.0 - p) * loss).alias("mean_return_exact"),
        F.sqrt(F.sum((win - loss) * (win - loss) * p * (1.0 - p))).alias("std_return_exact"),
        F.count(F.lit(1)).alias("n_bets"))


def daily_totals(bets: DataFrame, group=("game_date",)) -> DataFrame:
    """Bets, stake and expected value of the day."""
    return bets.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_games"),
        F.sum(F.col("recommended_bet").cast("int")).alias("recommended_bets"),
        F.sum("stake_amount").alias("total_stake"),
        F.sum("expected_value").alias("expected_value"))


def daily_report(bets: DataFrame, group=("game_date",), key: str = "game_id") -> DataFrame:
    """Every game of a day as a record, best expected value first (``rank``
    from 1).  One row per game, so no list grows inside a day; ``daily_totals`` has the
    day's sums."""
    return ranked(bets, list(group), "expected_value", key).select(
        *group, "rank", key, "home_team", "away_team", "best_bet_team", "best_bet_odds", "best_bet_edge",
        "recommended_bet", "stake_amount", "expected_value")
