"""Model and betting performance queries (A11-A20, A28, J-5, W8, W9, W11, M9, T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.operators import performance as P
from lineup.plans import derive
from lineup.plans.catalog import register
from lineup.plans.q_features import FEAT_SQL, FINAL

PLOG = "with " + derive.cte_prediction_log() + " "
BETS = "with " + derive.cte_bets() + " "


@register("accuracy_overall", PLOG + "select avg(case when correct_prediction then 1e0 else 0e0 end) as accuracy, "
          "count(*) as predictions, cast(sum(cast(correct_prediction as int)) as bigint) as correct from plog",
          doubles=["accuracy"])
def accuracy_overall(spark, sf_dir):
    """Share of correct predictions (a missing result counts as wrong)."""
    return P.accuracy(derive.prediction_log(spark, sf_dir)).withColumn("correct", F.col("correct").cast("bigint"))


@register("accuracy_by_confidence", PLOG + ", b as (select case when confidence > 0 and confidence <= 0.6 then "
          "'<60%' when confidence > 0.6 and confidence <= 0.7 then '60-70%' when confidence > 0.7 and confidence "
          "<= 0.8 then '70-80%' when confidence > 0.8 and confidence <= 1.0 then '>80%' end as confidence_bucket, "
          "correct_prediction from plog) select confidence_bucket, count(*) as total_predictions, avg(case when "
          "correct_prediction then 1e0 else 0e0 end) as accuracy from b where confidence_bucket is not null "
          "group by 1", doubles=["accuracy"])
def accuracy_by_confidence(spark, sf_dir):
    """Accuracy per right-closed confidence bucket."""
    return P.accuracy_by_confidence(derive.prediction_log(spark, sf_dir))


@register("accuracy_weekly", PLOG + "select cast(date_trunc('week', date) as date) as week, count(*) as "
          "predictions, cast(sum(cast(correct_prediction as int)) as bigint) as correct, avg(case when "
          "correct_prediction then 1e0 else 0e0 end) as accuracy from plog group by 1", doubles=["accuracy"])
def accuracy_weekly(spark, sf_dir):
    """Weekly accuracy (weeks start Monday)."""
    return P.accuracy_weekly(derive.prediction_log(spark, sf_dir)).withColumn(
        "correct", F.col("correct").cast("bigint"))


@register("prediction_volume", PLOG + "select date as day, count(*) as predictions from plog group by 1")
def prediction_volume(spark, sf_dir):
    """Predictions per day."""
    return P.prediction_volume(derive.prediction_log(spark, sf_dir))


@register("classification_metrics",
          "with m as (select cast(count(*) filter (where quality = 1 and toxic = 1) as bigint) as tp, "
          "cast(count(*) filter (where quality = 0 and toxic = 1) as bigint) as fp, cast(count(*) filter (where "
          "quality = 1 and toxic = 0) as bigint) as fn, cast(count(*) filter (where quality = 0 and toxic = 0) as "
          "bigint) as tn, avg(case when quality = toxic then 1e0 else 0e0 end) as accuracy from labels), "
          "p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as precision, case when "
          "tp + fn > 0 then tp / (tp + fn) else 0e0 end as recall from m) select *, case when precision + recall "
          "> 0 then 2 * precision * recall / (precision + recall) else 0e0 end as f1_score from p",
          doubles=["accuracy", "precision", "recall", "f1_score"])
def classification_metrics(spark, sf_dir):
    """Confusion counts, precision, recall, F1 (labels: quality as actual, toxic as predicted)."""
    return P.classification_metrics(derive.read(spark, sf_dir, "labels"), "quality", "toxic")


BS = ["total_profit", "win_rate", "avg_bet", "total_wagered", "avg_win", "avg_loss", "roi_pct"]


@register("betting_summary", BETS + ", s as (select sum(profit_loss) as total_profit, count(*) as total_bets, "
          "avg(case when profit_loss > 0 then 1e0 else 0e0 end) as win_rate, avg(bet_amount) as avg_bet, "
          "sum(bet_amount) as total_wagered, cast(count(*) filter (where profit_loss > 0) as bigint) as "
          "winning_bets, cast(count(*) filter (where profit_loss < 0) as bigint) as losing_bets, avg(case when "
          "profit_loss > 0 then profit_loss end) as avg_win, avg(case when profit_loss < 0 then profit_loss end) "
          "as avg_loss from bets) select *, case when total_wagered > 0 then total_profit / total_wagered * 100 "
          "end as roi_pct from s", doubles=BS)
def betting_summary(spark, sf_dir):
    """A16 + A17: P&L, win share, stake, ROI, average win and loss."""
    return P.betting_summary(derive.bets(spark, sf_dir))


@register("daily_pnl", BETS + "select bet_date as day, sum(profit_loss) as daily_pnl, count(*) as bets from bets "
          "group by 1", doubles=["daily_pnl"])
def daily_pnl(spark, sf_dir):
    """P&L per day."""
    return P.daily_pnl(derive.bets(spark, sf_dir))


@register("cumulative_pnl", BETS + "select bet_id, bet_date, sum(profit_loss) over (order by bet_date, bet_id "
          "rows between unbounded preceding and current row) as cumulative_pnl from bets",
          doubles=["cumulative_pnl"])
def cumulative_pnl(spark, sf_dir):
    """Running P&L in bet order, computed in parallel ranges."""
    return P.cumulative_pnl(derive.bets(spark, sf_dir)).select("bet_id", "bet_date", "cumulative_pnl")


@register("streaks", BETS + ", f as (select *, profit_loss > 0 as w from bets where profit_loss is not null), "
          "i as (select w, row_number() over (order by bet_date, bet_id) - row_number() over (partition by w "
          "order by bet_date, bet_id) as island from f), r as (select w, island, count(*) as len from i group by "
          "all) select coalesce(max(case when w then len end), 0) as longest_win_streak, coalesce(max(case when "
          "not w then len end), 0) as longest_loss_streak, cast(count(*) filter (where w) as bigint) as "
          "win_streaks, cast(count(*) filter (where not w) as bigint) as loss_streaks from r")
def streaks(spark, sf_dir):
    """Longest win and loss streaks (gaps and islands, no row loop)."""
    return P.streaks(derive.bets(spark, sf_dir))


@register("stake_quantiles", BETS + ", e as (select list_sort(list_distinct([quantile_cont(bet_amount, 0.0), "
          "quantile_cont(bet_amount, 0.2), quantile_cont(bet_amount, 0.4), quantile_cont(bet_amount, 0.6), "
          "quantile_cont(bet_amount, 0.8), quantile_cont(bet_amount, 1.0)])) as e from bets), b as (select "
          "bets.*, greatest(0, len(list_filter(e.e, lambda x: x < bet_amount)) - 1) as bet_size_bucket from bets, e "
          "where bet_amount is not null) select cast(bet_size_bucket as int) as bet_size_bucket, count(*) as "
          "bet_count, avg(case when profit_loss > 0 then 1e0 else 0e0 end) as win_rate, avg(profit_loss) as "
          "avg_pnl, avg(bet_amount) as avg_bet_size from b group by 1",
          doubles=["win_rate", "avg_pnl", "avg_bet_size"])
def stake_quantiles(spark, sf_dir):
    """Statistics per stake quintile (exact edges, duplicates dropped)."""
    return P.stake_quantiles(derive.bets(spark, sf_dir))


@register("histogram_20", BETS + ", m as (select min(bet_amount) as lo, max(bet_amount) as hi from bets) select "
          "cast(case when m.hi = m.lo then 0 else least(19, floor((bet_amount - m.lo) / ((m.hi - m.lo) / 20))) "
          "end as int) as bin, count(*) as count, min(bet_amount) as min_value, max(bet_amount) as max_value "
          "from bets, m where bet_amount is not null group by 1", doubles=["min_value", "max_value"])
def histogram_20(spark, sf_dir):
    """20 equal-width bins of the stake."""
    return P.histogram(derive.bets(spark, sf_dir), "bet_amount", 20)


@register("prediction_outcomes", "with " + derive.cte_prediction_log() + " select date as game_date, count(*) as "
          "total_games, cast(sum(cast(correct_prediction as int)) as bigint) as correct_predictions, avg(case "
          "when correct_prediction then 1e0 else 0e0 end) as accuracy from plog group by 1", doubles=["accuracy"])
def prediction_outcomes(spark, sf_dir):
    """J-5 + A28: predictions joined to results, daily totals and correct count."""
    from lineup.operators.markets import pick_winner
    out = P.prediction_outcomes(pick_winner(derive.predictions(spark, sf_dir)), derive.results(spark, sf_dir))
    return P.daily_performance(out).withColumn("correct_predictions", F.col("correct_predictions").cast("bigint"))


@register("drift_flag", PLOG + ", d as (select date as day, count(*) as n, sum(cast(correct_prediction as int)) "
          "as c from plog group by 1), w as (select day, sum(c) over (order by day range between interval 29 days "
          "preceding and current row) / sum(n) over (order by day range between interval 29 days preceding and "
          "current row) as trailing_accuracy, sum(c) over (order by day range between unbounded preceding and "
          "interval 30 days preceding) / sum(n) over (order by day range between unbounded preceding and "
          "interval 30 days preceding) as baseline_accuracy from d) select *, trailing_accuracy < 0.55 or "
          "coalesce(baseline_accuracy - trailing_accuracy > 0.05, false) as retrain from w",
          doubles=["trailing_accuracy", "baseline_accuracy"])
def drift_flag(spark, sf_dir):
    """M9: trailing 30-day accuracy against the earlier baseline, retrain flag."""
    return P.drift_flags(derive.prediction_log(spark, sf_dir))


@register("temporal_split", FEAT_SQL + ", ff as (select " + ", ".join(FINAL) + " from feat where games_played >= 3), "
          "o as (select game_date, row_number() over (order by game_date) - 1 as pos, count(*) over () as n "
          "from ff), c as (select min(game_date) as cut from o where pos = floor(n * 0.8)) select case when "
          "game_date < c.cut then 'train' else 'test' end as split, count(*) as rows, min(game_date) as "
          "min_date, max(game_date) as max_date from ff, c group by 1")
def temporal_split(spark, sf_dir):
    """W11 + M2 (Q5 fixed): chronological 80/20 split at a cutoff date."""
    from lineup.plans.q_features import features_final
    s = P.temporal_split(features_final(spark, sf_dir))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("game_date").alias("min_date"),
                                  F.max("game_date").alias("max_date"))


@register("latest_n", PLOG + "select * from plog order by date desc, game_id desc limit 1000",
          doubles=["confidence", "predicted_prob"])
def latest_n(spark, sf_dir):
    """T5: the latest 1000 predictions (limit is the feature)."""
    return derive.prediction_log(spark, sf_dir).orderBy(F.desc("date"), F.desc("game_id")).limit(1000)
