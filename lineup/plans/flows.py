"""End-to-end jobs: the feature build and the daily betting run (survey §3).

Each is one lazy DataFrame chain; the feature build ends in a write.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineup.config import FeatureConfig, StakeConfig
from lineup.operators import games as G
from lineup.operators import markets as M
from lineup.operators import model as ML
from lineup.operators import staking as ST
from lineup.operators import windows as WN
from lineup.sources import files as FS

GAMES_CSV_SCHEMA = (
    "game_id string, game_date string, season_id int, team_name_home string, team_name_away string, "
    "team_abbreviation_home string, team_abbreviation_away string, pts_home short, pts_away short, "
    "fg_pct_home double, fg_pct_away double, fg3_pct_home double, fg3_pct_away double, ft_pct_home double, "
    "ft_pct_away double, reb_home double, reb_away double, ast_home double, ast_away double, stl_home double, "
    "stl_away double, blk_home double, blk_away double, tov_home double, tov_away double")


def build_features(spark: SparkSession, games_csv: str, out_path: str,
                   cfg: FeatureConfig = FeatureConfig(as_of=True)) -> dict:
    """S1 -> P1/P2 -> P3/P4 -> W1-W7 -> P11/P12 -> S11 + S13: games CSV to a
    season-partitioned Parquet feature table plus a metadata JSON beside it.  The
    default features use earlier games only; seasons are the games' own."""
    games = G.clean_games(FS.read_csv(spark, games_csv, GAMES_CSV_SCHEMA))
    feats = WN.final_features(WN.participant_features(G.team_games(games), cfg), cfg, keep=("season_id",))
    FS.write_parquet(feats, out_path, partition_by="season_id")
    written = spark.read.parquet(out_path)
    meta = FS.dataset_metadata(written, ["game_date"]).first().asDict()
    meta["columns"] = list(meta["columns"])
    meta.update(FS.files_size(written).first().asDict())
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(out_path.rstrip("/") + "_metadata")
    return meta


def daily_bets(spark: SparkSession, model_base: str, schedule: DataFrame, features: DataFrame,
               bankroll: float, stake: StakeConfig = StakeConfig(), consensus: DataFrame | None = None):
    """§3.3: latest model -> upcoming feature rows (M8) -> scores (M7) ->
    paired game probabilities (J-4) -> edges (F2-F7) -> stakes (F11) ->
    risk (M11) and report (J7).  ``consensus`` holds decimal prices.  Returns (bets, risk,
    report); the caller may persist the bets, which the other two read."""
    model, meta = ML.load_model(spark, model_base)
    if consensus is not None:
        schedule = M.join_odds(schedule, consensus)
    cols = meta.get("features") or ML.feature_columns(features)
    rows = ML.upcoming_features(schedule.select("game_id", "game_date", "home_team", "away_team"),
                                features, [c for c in cols if c != "is_home"])
    scored = ML.score(model, ML.prepare(rows.withColumn("target_win", F.lit(False)), cols))
    probs = scored.select("game_id", "game_date", F.col("team_name").alias("team"),
                          (F.col("is_home") > 0).alias("is_home"), F.col("p_win").alias("p"))
    games = M.pair_games(probs).join(schedule.select("game_id", "home_odds", "away_odds"), "game_id")
    bets = ST.bet_sizes(M.betting_edges(games), bankroll, stake)
    return bets, ST.risk_closed_form(bets, ("game_date",)), ST.daily_report(bets, ("game_date",))
