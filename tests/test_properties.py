"""Invariants (survey §5): row preservation, probability ranges, stake caps."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineup.config import StakeConfig
from lineup.operators import markets as M
from lineup.operators import staking as ST
from lineup.plans import derive

row = st.tuples(st.floats(0.0, 1.0), st.floats(1.0, 15.0), st.one_of(st.none(), st.floats(-0.5, 0.5)))


@settings(max_examples=12, deadline=None)
@given(st.lists(row, min_size=1, max_size=30), st.sampled_from([0.0, 5000.0, 10000.0]))
def test_stake_invariants(spark, rows, bankroll):
    df = spark.createDataFrame([(f"g{i}", p, o, e) for i, (p, o, e) in enumerate(rows)],
                               "game_id string, best_bet_prob double, best_bet_odds double, best_bet_edge double")
    out = ST.bet_sizes(df, bankroll, StakeConfig()).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0.0 <= r.kelly_fraction <= 1.0
        assert 0.0 <= r.stake_amount <= 0.1 * bankroll + 1e-9
        if not r.recommended_bet:
            assert r.stake_amount == 0 and r.expected_value == 0
        if r.stake_amount > 0:
            assert r.expected_value > -1e-9  # positive Kelly stake implies non-negative EV


def test_edges_and_pairs_on_driver_tables(spark, small_dir):
    pred = derive.predictions(spark, small_dir)
    e = M.betting_edges(pred)
    assert e.select("game_id").exceptAll(pred.select("game_id")).count() == 0
    assert pred.select("game_id").exceptAll(e.select("game_id")).count() == 0
    bad = e.where("home_implied_prob <= 0 or home_implied_prob > 1 or away_implied_prob <= 0 "
                  "or away_implied_prob > 1 or abs(home_prob + away_prob - 1) > 1e-9").count()
    assert bad == 0
    bets = ST.bet_sizes(e, 10000, StakeConfig())
    assert bets.count() == pred.count()
    assert bets.where(F.col("stake_amount") > 1000 + 1e-9).count() == 0
