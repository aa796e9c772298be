"""Feature build end to end: CSV in, partitioned Parquet and metadata out."""

from pyspark.sql import functions as F

from lineup.plans import derive
from lineup.plans.flows import build_features
from lineup.session import shared_dir
from lineup.sources import files as FS


def test_build_features(spark, small_dir):
    g = derive.games(spark, small_dir)
    csv = shared_dir(spark, "t_games_csv")
    FS.write_csv(g.withColumn("game_date", F.date_format("game_date", "yyyy-MM-dd")), csv)
    out = shared_dir(spark, "t_features")
    meta = build_features(spark, csv, out)
    back = spark.read.parquet(out)
    assert meta["rows"] == back.count() > 0
    assert "avg_pts_last_10" in back.columns and "season_id" in back.columns
    assert back.where(F.col("season_id") == 1996).count() > 0 and meta["bytes"] > 0
    # the games' own seasons: one that spans New Year stays whole
    split = g.withColumn("season_id", F.when(F.month("game_date") >= 7, F.year("game_date")).otherwise(
        F.year("game_date") - 1))
    csv2, out2 = shared_dir(spark, "t_games_csv"), shared_dir(spark, "t_features")
    FS.write_csv(split.withColumn("game_date", F.date_format("game_date", "yyyy-MM-dd")), csv2)
    build_features(spark, csv2, out2)
    months = {r.m for r in spark.read.parquet(out2).where("season_id = 1996").select(
        F.month("game_date").alias("m")).distinct().collect()}
    assert months >= {1, 12}


def test_daily_bets(spark, small_dir):
    from lineup.config import FeatureConfig, ForestConfig, StakeConfig
    from lineup.operators import model as ML
    from lineup.operators import windows as WN
    from lineup.plans.flows import daily_bets
    from lineup.plans.q_features import features
    cfg = FeatureConfig(as_of=True)
    feats = WN.final_features(features(spark, small_dir, cfg), cfg)
    model, metrics, _ = ML.train(feats, ForestConfig(num_trees=5, max_depth=4))
    base = shared_dir(spark, "t_daily_model")
    ML.save_model(spark, model, base, metrics)
    g = derive.games(spark, small_dir)
    last = g.agg(F.max("game_date")).first()[0]
    sched = g.where(F.col("game_date") == last).select(
        "game_id", "game_date", F.col("team_name_home").alias("home_team"),
        F.col("team_name_away").alias("away_team"), F.lit(1.9).alias("home_odds"), F.lit(2.1).alias("away_odds"))
    bets, risk, report = daily_bets(spark, base, sched, feats, 10000, StakeConfig(min_edge=-1.0))
    assert bets.count() == sched.count()
    assert bets.agg(F.sum("stake_amount")).first()[0] <= 10000
    r = risk.first()
    assert r.std_return_exact >= 0 and r.n_bets == sched.count()
    assert report.count() == sched.count()
