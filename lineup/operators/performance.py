"""Model and betting performance (A11-A20, A28, J-5, W8, W9, W11, M9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineup.config import DriftConfig
from lineup.constants import CONFIDENCE_EDGES, CONFIDENCE_LABELS
from lineup.operators.sequence import exact_quantiles, islands, running_sums


def correct(predicted: str = "predicted_winner", actual: str = "actual_winner") -> Column:
    """A prediction is correct only when both sides are known and equal
    (pandas ``==`` with a missing value is False)."""
    return F.coalesce(F.col(predicted) == F.col(actual), F.lit(False))


def accuracy(log: DataFrame, flag: str | None = "correct_prediction") -> DataFrame:
    """Share of correct predictions, count and correct count."""
    c = F.col(flag) if flag else correct()
    return log.agg(F.avg(c.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("predictions"),
                   F.sum(c.cast("int")).alias("correct"))


def confidence_bucket(conf: Column) -> Column:
    """Right-closed buckets (0, .6] (.6, .7] (.7, .8] (.8, 1]; outside -> NULL."""
    e, lab = CONFIDENCE_EDGES, CONFIDENCE_LABELS
    out = None
    for lo, hi, name in zip(e[:-1], e[1:], lab):
        cond = (conf > lo) & (conf <= hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def accuracy_by_confidence(log: DataFrame, conf: str = "confidence",
                           flag: str = "correct_prediction") -> DataFrame:
    b = confidence_bucket(F.col(conf))
    return log.where(b.isNotNull()).groupBy(b.alias("confidence_bucket")).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(F.col(flag).cast("double")).alias("accuracy"))


def accuracy_weekly(log: DataFrame, date: str = "date", flag: str = "correct_prediction") -> DataFrame:
    """Weeks start on Monday."""
    return log.groupBy(F.to_date(F.date_trunc("week", F.col(date))).alias("week")).agg(
        F.count(F.lit(1)).alias("predictions"), F.sum(F.col(flag).cast("int")).alias("correct"),
        F.avg(F.col(flag).cast("double")).alias("accuracy"))


def prediction_volume(log: DataFrame, date: str = "date") -> DataFrame:
    """Predictions per day."""
    return log.groupBy(F.to_date(date).alias("day")).agg(F.count(F.lit(1)).alias("predictions"))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (0 when a
    denominator is 0), in one aggregation."""
    a, p = F.col(actual), F.col(predicted)
    m = df.agg(F.count_if((a == 1) & (p == 1)).alias("tp"), F.count_if((a == 0) & (p == 1)).alias("fp"),
               F.count_if((a == 1) & (p == 0)).alias("fn"), F.count_if((a == 0) & (p == 0)).alias("tn"),
               F.avg(F.coalesce(a == p, F.lit(False)).cast("double")).alias("accuracy"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    m = m.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return m.withColumn("f1_score", f1)


def betting_summary(bets: DataFrame, pnl: str = "profit_loss", amount: str = "bet_amount") -> DataFrame:
    """A16 + A17: P&L, bets, win share, average stake, ROI % (only when
    something was wagered), average win / loss and their counts (a zero P&L
    is neither)."""
    x, a = F.col(pnl), F.col(amount)
    s = bets.agg(F.sum(x).alias("total_profit"), F.count(F.lit(1)).alias("total_bets"),
                 F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(a).alias("avg_bet"),
                 F.sum(a).alias("total_wagered"), F.count_if(x > 0).alias("winning_bets"),
                 F.count_if(x < 0).alias("losing_bets"), F.avg(F.when(x > 0, x)).alias("avg_win"),
                 F.avg(F.when(x < 0, x)).alias("avg_loss"))
    return s.withColumn("roi_pct", F.when(F.col("total_wagered") > 0,
                                          F.col("total_profit") / F.col("total_wagered") * 100))


def daily_pnl(bets: DataFrame, date: str = "bet_date", pnl: str = "profit_loss") -> DataFrame:
    """A18."""
    return bets.groupBy(F.to_date(date).alias("day")).agg(F.sum(pnl).alias("daily_pnl"),
                                                          F.count(F.lit(1)).alias("bets"))


def cumulative_pnl(bets: DataFrame, date: str = "bet_date", key: str = "bet_id",
                   pnl: str = "profit_loss") -> DataFrame:
    """Running P&L in (date, id) order, exact and parallel: day totals and
    their offsets, then a running sum inside each day (a busy day in ranges of ids)."""
    return running_sums(bets, [], [date, key], {"cumulative_pnl": F.col(pnl)})


def streaks(bets: DataFrame, date: str = "bet_date", key: str = "bet_id", pnl: str = "profit_loss",
            group=()) -> DataFrame:
    """Runs of wins (P&L > 0) and non-wins in (date, id) order; longest
    and count of each kind."""
    flagged = bets.withColumn("_win", F.col(pnl) > 0).where(F.col("_win").isNotNull())
    isl = islands(flagged, list(group), [date, key], "_win")
    runs = isl.groupBy(*group, "_win", "island").agg(F.count(F.lit(1)).alias("_len"))
    return runs.groupBy(*group).agg(
        F.coalesce(F.max(F.when(F.col("_win"), F.col("_len"))), F.lit(0)).alias("longest_win_streak"),
        F.coalesce(F.max(F.when(~F.col("_win"), F.col("_len"))), F.lit(0)).alias("longest_loss_streak"),
        F.count_if(F.col("_win")).alias("win_streaks"), F.count_if(~F.col("_win")).alias("loss_streaks"))


def stake_quantiles(bets: DataFrame, amount: str = "bet_amount", pnl: str = "profit_loss",
                    q: int = 5) -> DataFrame:
    """Statistics per stake quantile bucket (exact quantile edges,
    duplicate edges dropped, right-closed, lowest value in the first bucket).
    Edges are at most ``q + 1`` values, used as a scalar subquery."""
    probs = [i / q for i in range(q + 1)]
    edges = exact_quantiles(bets, amount, probs).agg(
        F.array_sort(F.collect_set("value")).alias("e")).scalar()
    x = F.col(amount)
    bets = bets.where(x.isNotNull()).withColumn("_edges", edges)
    below = sum(F.when(F.get("_edges", F.lit(i)) < x, 1).otherwise(0) for i in range(q + 1))
    bucket = F.greatest(F.lit(0), below - 1)
    p = F.col(pnl)
    return bets.groupBy(bucket.alias("bet_size_bucket")).agg(
        F.count(F.lit(1)).alias("bet_count"), F.avg((p > 0).cast("double")).alias("win_rate"),
        F.avg(p).alias("avg_pnl"), F.avg(x).alias("avg_bet_size"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Exactly ``bins`` equal-width bins between min and max; the max
    falls in the last bin.  Min and max enter as scalar subqueries."""
    x = F.col(col)
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((x - lo) / width).cast("int")))
    return df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.min(x).alias("min_value"), F.max(x).alias("max_value"))


def prediction_outcomes(pred: DataFrame, results: DataFrame, key: str = "game_id") -> DataFrame:
    """J-5: predictions left-joined to results; correct when the predicted
    winner equals the actual winner."""
    r = results.withColumnRenamed("winner", "actual_winner")
    j = pred.join(r, key, "left")
    return j.withColumn("correct_prediction", correct("predicted_winner", "actual_winner"))


def daily_performance(outcomes: DataFrame, date: str = "game_date") -> DataFrame:
    """Games and correct predictions per day."""
    c = F.col("correct_prediction")
    return outcomes.groupBy(date).agg(F.count(F.lit(1)).alias("total_games"),
                                      F.sum(c.cast("int")).alias("correct_predictions"),
                                      F.avg(c.cast("double")).alias("accuracy"))


def drift_flags(log: DataFrame, date: str = "date", flag: str = "correct_prediction",
                cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """M9: per day, trailing accuracy over ``trailing_days`` against the
    accuracy of all earlier days; retrain when it is below ``min_accuracy``
    or dropped by more than ``max_drop``.  Days are pre-aggregated, so the
    ordered windows run over one row per day."""
    day = log.groupBy(F.to_date(date).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("int")).alias("c"))
    d = F.unix_date("day")
    trail = Window.orderBy(d).rangeBetween(-(cfg.trailing_days - 1), 0)
    before = Window.orderBy(d).rangeBetween(Window.unboundedPreceding, -cfg.trailing_days)
    out = day.withColumns({
        "trailing_accuracy": F.sum("c").over(trail) / F.sum("n").over(trail),
        "baseline_accuracy": F.sum("c").over(before) / F.sum("n").over(before),
    })
    drop = F.col("baseline_accuracy") - F.col("trailing_accuracy")
    return out.withColumn("retrain", (F.col("trailing_accuracy") < cfg.min_accuracy) |
                          F.coalesce(drop > cfg.max_drop, F.lit(False))).drop("n", "c")


def temporal_split(df: DataFrame, date: str = "game_date", train_fraction: float = 0.8) -> DataFrame:
    """W11 (Q5 fixed): the cutoff is the date at position ``int(n * f)`` in
    date order; earlier dates train, the rest test, so a date is never split.
    Adds ``split`` = 'train' / 'test' (a NULL date tests).  The cutoff needs one row per day."""
    days = df.where(F.col(date).isNotNull()).groupBy(F.unix_date(F.to_date(date)).alias("_d")).agg(
        F.count(F.lit(1)).alias("_c"))
    days = days.select("_d", F.sum("_c").over(Window.orderBy("_d")).alias("_end"),
                       F.sum("_c").over(Window.partitionBy()).alias("_n"))
    cut = days.where(F.col("_end") > F.floor(F.col("_n") * F.lit(train_fraction))).agg(F.min("_d")).scalar()
    return df.withColumn("split", F.when(F.unix_date(F.to_date(date)) < cut, "train").otherwise("test"))


def stratified_split(df: DataFrame, label: str, key: str, train_fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """M2 without dates: a repeatable random split with the same train share in every
    label.  Rows are ranked per label by a hash of ``key``; the rank comes from counts per
    (label, hash range), so a label of half of all rows is not sorted in one task."""
    from lineup.operators.sequence import row_index
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30))
    ranked = row_index(df.withColumn("_h", h), [label], ["_h"], "_pos")
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(label, "_label")
    out = ranked.join(n, ranked[label].eqNullSafe(n["_label"]))
    split = F.when(F.col("_pos") < F.floor(F.col("_n") * train_fraction), "train").otherwise("test")
    return out.withColumn("split", split).drop("_h", "_pos", "_n", "_label")
