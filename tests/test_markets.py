"""Edges, winner pick, pairing and odds conversions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lineup.functions import odds as O
from lineup.operators import markets as M


@pytest.mark.parametrize("p,o,e", [(0.6, 1.8, 0.6 - 1 / 1.8), (0.5, 2.0, 0.0), (0.4, 2.0, -0.1)])
def test_edge_pins(spark, p, o, e):
    r = spark.range(1).select(O.edge(F.lit(p), O.decimal_to_prob(F.lit(o))).alias("e")).first()
    assert r.e == pytest.approx(e, abs=1e-9)
    if p == 0.6:
        assert abs(r.e - 0.044) < 0.001


def _pred(spark, rows):
    return spark.createDataFrame(rows, "game_id string, game_date date, home_team string, away_team string, "
                                       "home_prob double, away_prob double, home_odds double, away_odds double")


def test_missing_odds_gives_null_edge(spark):
    e = M.betting_edges(_pred(spark, [("g", dt.date(2024, 1, 1), "A", "B", 0.6, 0.4, None, 2.0)])).first()
    assert e.home_implied_prob is None and e.home_edge is None
    assert e.away_implied_prob == pytest.approx(0.5)
    # a NULL comparison picks away; the best edge is NULL when one side is NULL
    assert e.best_bet_team == "B" and e.best_bet_edge is None and e.best_bet_odds == 2.0


def test_no_games_gives_empty(spark):
    assert M.betting_edges(_pred(spark, [])).count() == 0


def test_winner_tie_picks_away(spark):
    r = M.pick_winner(_pred(spark, [("g", dt.date(2024, 1, 1), "A", "B", 0.5, 0.5, 2.0, 2.0)])).first()
    assert r.predicted_winner == "B" and r.confidence == 0.5


def test_pair_normalize_by_key(spark):
    rows = spark.createDataFrame([("g1", dt.date(2024, 1, 1), "A", True, 0.6), ("g1", dt.date(2024, 1, 1), "B",
                                  False, 0.6), ("g2", dt.date(2024, 1, 2), "C", False, 0.2),
                                  ("g2", dt.date(2024, 1, 2), "D", True, 0.6)],
                                 "game_id string, game_date date, team string, is_home boolean, p double")
    out = {r.game_id: r for r in M.pair_games(rows).collect()}
    assert out["g1"].home_prob == pytest.approx(0.5) and out["g1"].predicted_winner == "B"
    assert out["g2"].home_team == "D" and out["g2"].home_prob == pytest.approx(0.75)
    for r in out.values():
        assert r.home_prob + r.away_prob == pytest.approx(1.0)


def test_american_odds(spark):
    r = spark.range(1).select(O.american_to_prob(F.lit(150)).alias("a"), O.american_to_prob(F.lit(-150)).alias("b"),
                              O.american_to_prob(F.lit(-150), fixed=True).alias("c"),
                              O.american_to_prob(F.lit("even")).alias("d")).first()
    assert r.a == pytest.approx(0.4) and r.b is None and r.c == pytest.approx(0.6) and r.d is None


def test_team_normalize_and_consensus(spark):
    df = spark.createDataFrame([("Boston Celtics",), ("Seattle Supersonics",)], "name string")
    got = {r.name: r.team_abbr for r in M.normalize_team(df, "name").collect()}
    assert got == {"Boston Celtics": "BOS", "Seattle Supersonics": "SEA"}
    odds = spark.createDataFrame([(dt.date(2024, 1, 1), "A", "B", 1.8, 2.1), (dt.date(2024, 1, 1), "A", "B", 2.0, None)],
                                 "game_date date, home_team string, away_team string, home_odds double, away_odds double")
    c = M.odds_consensus(odds).first()
    assert c.home_odds == pytest.approx(1.9) and c.away_odds == pytest.approx(2.1)
    sched = spark.createDataFrame([(dt.date(2024, 1, 1), "A", "B", None, None), (dt.date(2024, 1, 2), "C", "D", 1.5, 2.5)],
                                  "game_date date, home_team string, away_team string, home_odds double, away_odds double")
    j = {r.home_team: r for r in M.join_odds(sched, M.odds_consensus(odds)).collect()}
    assert j["A"].home_odds == pytest.approx(1.9) and j["C"].home_odds == 1.5


def test_american_to_decimal(spark):
    got = [r[0] for r in spark.createDataFrame([(-150.0,), (160.0,), (0.0,), (None,), (-100.0,)], "o double").select(
        O.american_to_decimal("o")).collect()]
    assert got == [pytest.approx(1 + 100 / 150), pytest.approx(2.6), None, None, pytest.approx(2.0)]


def test_a_document_is_read_once_and_apart_from_its_building(spark, small_dir):
    """One typed read of each document; the coalesce keeps its text building out of the parsing's method."""
    from lineup.plans import derive
    from lineup.sources.odds_json import flatten_odds
    plan = flatten_odds(derive.odds_documents(spark, small_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") == 1 and "Repartition" in plan.split("try_variant_get(")[1]
    docs = [('[{"id":7,"home_team":"H","away_team":"A","bookmakers":["x",{"key":"b","markets":[3,{"key":"h2h","outcomes":'
             '["y",{"name":"H","price":"even"},{"name":"A","price":"120"}]}]}]},5,{"home_team":"","away_team":"A"}]',),
            ('{"id":1}',)]
    rows = flatten_odds(spark.createDataFrame(docs, "doc string")).collect()
    assert [(r.game_id, r.bookmaker, r.home_odds, r.away_odds) for r in rows] == [("7", "b", None, 120.0)]
