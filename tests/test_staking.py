"""Staking pins of the reference tests plus invariants."""

import pytest
from pyspark.sql import functions as F

from lineup.config import StakeConfig
from lineup.functions import odds as O
from lineup.operators import staking as ST

CFG = StakeConfig(kelly_fraction=0.5, min_edge=0.02, max_bet_size=0.1)


def _scalar(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_kelly_scalar_pins(spark):
    assert _scalar(spark, O.kelly_fraction(F.lit(0.6), F.lit(2.0))) == pytest.approx(0.2)
    assert _scalar(spark, O.fractional_stake(F.lit(0.6), F.lit(2.0), 10000, 0.5, 0.1)) == pytest.approx(1000)
    assert _scalar(spark, O.fractional_stake(F.lit(0.9), F.lit(2.0), 10000, 0.5, 0.1)) <= 1000
    assert _scalar(spark, O.fractional_stake(F.lit(0.4), F.lit(1.5), 10000, 0.5, 0.1)) == 0
    # degenerate probabilities and odds give 0, NULL inputs too
    assert _scalar(spark, O.kelly_fraction(F.lit(1.0), F.lit(2.0))) == 0
    assert _scalar(spark, O.kelly_fraction(F.lit(0.6), F.lit(1.0))) == 0
    assert _scalar(spark, O.kelly_fraction(F.lit(None).cast("double"), F.lit(2.0))) == 0


def _three(spark):
    return spark.createDataFrame(
        [("g1", "LAL", "BOS", "LAL", 0.65, 1.8, 0.08), ("g2", "GSW", "PHX", "GSW", 0.55, 2.2, 0.01),
         ("g3", "BOS", "MIA", "MIA", 0.45, 2.0, -0.05)],
        "game_id string, home_team string, away_team string, best_bet_team string, best_bet_prob double, "
        "best_bet_odds double, best_bet_edge double")


def test_one_of_three_recommended(spark):
    b = ST.bet_sizes(_three(spark), 10000, CFG).collect()
    assert sum(r.recommended_bet for r in b) == 1
    assert len(b) == 3
    for r in b:
        assert r.stake_amount <= 1000 + 1e-9
        if not r.recommended_bet:
            assert r.stake_amount == 0 and r.expected_value == 0 and r.kelly_fraction == 0


def test_row_set_preserved_and_total_stake_bounds(spark):
    edges = spark.createDataFrame(
        [("game1", 0.65, 1.8, 0.094), ("game2", 0.55, 2.2, 0.095), ("game3", 0.55, 1.85, 0.009)],
        "game_id string, best_bet_prob double, best_bet_odds double, best_bet_edge double")
    for bank in (5000, 10000, 20000):
        b = ST.bet_sizes(edges, bank, CFG)
        assert b.select("game_id").exceptAll(edges.select("game_id")).count() == 0
        assert edges.select("game_id").exceptAll(b.select("game_id")).count() == 0
        total = b.agg(F.sum("stake_amount")).first()[0]
        assert total <= bank and total < 0.5 * bank
        assert {r.game_id for r in b.where("recommended_bet").collect()} == {"game1", "game2"}


def test_zero_bankroll_and_missing_columns(spark):
    b = ST.bet_sizes(_three(spark), 0, CFG)
    assert b.agg(F.sum("stake_amount")).first()[0] == 0
    with pytest.raises(ValueError):
        ST.bet_sizes(_three(spark).drop("best_bet_edge"), 10000, CFG)


def test_null_edge_not_recommended(spark):
    df = spark.createDataFrame([("g", 0.6, 2.0, None)],
                               "game_id string, best_bet_prob double, best_bet_odds double, best_bet_edge double")
    r = ST.bet_sizes(df, 10000, CFG).first()
    assert r.recommended_bet is False and r.stake_amount == 0


def test_return_distribution(spark):
    import numpy as np
    values = [float((i * 37) % 23) - 11.5 for i in range(60)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(None, 4.25), (0, None)], "g int, x double")
    got = {r.g: r for r in ST.return_distribution(df, "x", ("g",)).collect()}
    assert set(got) == {0, 1, None}
    for g in (0, 1):
        own = np.array([v for i, v in enumerate(values) if i % 2 == g])
        r = got[g]
        assert r.n_days == len(own) and r.mean_return == pytest.approx(own.mean())
        assert r.std_return == pytest.approx(own.std()) and r.prob_profit == pytest.approx((own > 0).mean())
        assert [r.percentile_5, r.percentile_95] == pytest.approx(np.quantile(own, [0.05, 0.95]).tolist())
        assert (r.max_loss, r.max_gain) == (own.min(), own.max())


def test_closed_form_equals_all_outcomes(spark):
    from itertools import product
    rows = [(f"b{i}", 0.5 + i * 0.07, 1.9 + i * 0.2, 0.1) for i in range(5)]
    df = spark.createDataFrame(rows, "game_id string, best_bet_prob double, best_bet_odds double, "
                                     "best_bet_edge double").withColumn("day", F.lit(1))
    bets = ST.bet_sizes(df, 10000, StakeConfig(min_edge=0.0))
    stakes = [(r.stake_amount, r.best_bet_prob, r.best_bet_odds) for r in bets.collect()]
    mean = second = 0.0
    for won in product([True, False], repeat=len(stakes)):
        p = total = 0.0
        p = 1.0
        for w, (s, q, o) in zip(won, stakes):
            p *= q if w else 1 - q
            total += s * (o - 1) if w else -s
        mean += p * total
        second += p * total * total
    r = ST.risk_closed_form(bets, group=("day",)).first()
    assert r.mean_return_exact == pytest.approx(mean)
    assert r.std_return_exact == pytest.approx((second - mean * mean) ** 0.5)


def test_daily_report_keeps_every_game(spark):
    df = _three(spark).withColumns({"game_date": F.lit("2024-01-01").cast("date"), "home_team": F.lit("A"),
                                    "away_team": F.lit("B")})
    df = df.crossJoin(spark.range(20)).withColumn("game_id", F.concat("game_id", F.lit("-"), "id")).drop("id")
    if "best_bet_team" not in df.columns:
        df = df.withColumn("best_bet_team", F.lit("A"))
    bets = ST.bet_sizes(df, 10000, CFG)
    got = ST.daily_report(bets).collect()
    assert len(got) == 60 and sorted(r["rank"] for r in got) == list(range(1, 61))
    assert sum(r.recommended_bet for r in got) == 20
    evs = [r.expected_value for r in sorted(got, key=lambda r: r["rank"])]
    assert evs == sorted(evs, reverse=True)


def test_rank_bets_sorts_inside_days(spark):
    df = spark.createDataFrame([(i % 3, i, float((i * 7) % 11)) for i in range(60)],
                               "game_date int, game_id int, expected_value double")
    seen = {}
    for r in ST.rank_bets(df).collect():
        seen.setdefault(r.game_date, []).append((-r.expected_value, r.game_id))
    assert all(v == sorted(v) for v in seen.values()) and sum(map(len, seen.values())) == 60
