"""Descriptive analytics over the feature and game tables (A1-A10, T3, T7,
P20, X14-X16).  All are partial aggregations; per-participant tables are
small (one row per participant) and the second-level summaries run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from lineup.constants import DIFF_CLASSES, FORM_MARGIN, OUTLIER_DIFF, OUTLIER_RATES, RATE_CLASSES


def dataset_profile(features: DataFrame, date: str = "game_date", team: str = "team_name",
                    game: str = "game_id") -> DataFrame:
    """A1: rows, date range, distinct participants and games."""
    return features.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("min_date"),
                        F.max(date).alias("max_date"),
                        F.countDistinct(team).alias("unique_teams"),
                        F.countDistinct(game).alias("unique_games"))


def win_rate_split(features: DataFrame, target: str = "target_win", home: str = "is_home") -> DataFrame:
    """A2: overall and home / away win rate."""
    t = F.col(target).cast("double")
    return features.agg(F.avg(t).alias("win_rate"),
                        F.avg(F.when(F.col(home), t)).alias("home_win_rate"),
                        F.avg(F.when(~F.col(home), t)).alias("away_win_rate"))


TEAM_STATS = [
    ("season_win_pct", "season_win_pct"),
    ("season_avg_pts", "season_avg_pts"),
    ("season_avg_pts_allowed", "season_avg_pts_allowed"),
    ("avg_pts_last_10", "recent_avg_pts"),
    ("avg_pts_allowed_last_10", "recent_avg_pts_allowed"),
    ("win_pct_last_10", "recent_win_pct"),
]


def team_stats(features: DataFrame, team="team_name", target: str = "target_win") -> DataFrame:
    """A3: per participant (or any other columns ``team``) count, win rate and mean
    measures rounded to 3 (half-even, as pandas), differences taken after rounding."""
    aggs = [F.count(target).alias("games_played"),
            F.bround(F.avg(F.col(target).cast("double")), 3).alias("win_rate")]
    aggs += [F.bround(F.avg(src), 3).alias(dst) for src, dst in TEAM_STATS]
    aggs.append(F.bround(F.avg(F.col("is_home").cast("double")), 3).alias("home_game_pct"))
    keys = [team] if isinstance(team, str) else list(team)
    return features.groupBy(*keys).agg(*aggs).withColumns({
        "season_point_diff": F.col("season_avg_pts") - F.col("season_avg_pts_allowed"),
        "recent_point_diff": F.col("recent_avg_pts") - F.col("recent_avg_pts_allowed"),
    })


def league_summary(stats: DataFrame) -> DataFrame:
    """A4: league averages and ranges over the per-participant table."""
    return stats.agg(F.avg("win_rate").alias("avg_win_rate"),
                     F.avg("season_avg_pts").alias("avg_points"),
                     F.avg("season_avg_pts_allowed").alias("avg_points_allowed"),
                     F.avg("season_point_diff").alias("avg_point_diff"),
                     F.min("win_rate").alias("min_win_rate"), F.max("win_rate").alias("max_win_rate"),
                     F.min("season_avg_pts").alias("min_points"), F.max("season_avg_pts").alias("max_points"),
                     F.min("season_point_diff").alias("min_point_diff"),
                     F.max("season_point_diff").alias("max_point_diff"))


def _argmax(name: Column, value: Column) -> Column:
    # first (smallest name) wins a tie, as idxmax over a sorted index
    return F.min_by(name, F.struct(-value, name))


def _argmin(name: Column, value: Column) -> Column:
    return F.min_by(name, F.struct(value, name))


def form_label(recent: Column, season: Column, margin: float = FORM_MARGIN) -> Column:
    """Improving / declining when recent form is more than ``margin`` away."""
    return F.when(recent > season + margin, "improving") \
            .when(recent < season - margin, "declining").otherwise("steady")


def team_extremes(stats: DataFrame, team: str = "team_name") -> DataFrame:
    """A5 + X15: best, worst, top-scoring, best-defence and most balanced
    participant, counts of improving / declining ones, mean difference."""
    t = F.col(team)
    trend = form_label(F.col("recent_win_pct"), F.col("season_win_pct"))
    return stats.agg(
        _argmax(t, F.col("win_rate")).alias("best_team"),
        _argmin(t, F.col("win_rate")).alias("worst_team"),
        _argmax(t, F.col("season_avg_pts")).alias("top_scoring_team"),
        _argmin(t, F.col("season_avg_pts_allowed")).alias("best_defense_team"),
        _argmin(t, F.abs(F.col("season_point_diff"))).alias("most_balanced_team"),
        F.count(F.when(trend == "improving", 1)).alias("n_improving"),
        F.count(F.when(trend == "declining", 1)).alias("n_declining"),
        F.avg("season_point_diff").alias("avg_point_diff"))


def rate_class(rate: Column) -> Column:
    """Red below 0.4, orange below 0.6, else green."""
    low, high = RATE_CLASSES
    return F.when(rate < low, "red").when(rate < high, "orange").otherwise("green")


def diff_class(diff: Column) -> Column:
    """Red below -5, orange below 0, lightgreen below 5, else green."""
    low, zero, high = DIFF_CLASSES
    return F.when(diff < low, "red").when(diff < zero, "orange").when(diff < high, "lightgreen").otherwise("green")


def team_rank_classes(stats: DataFrame, team: str = "team_name") -> DataFrame:
    """Participants ranked by win rate (a distributed sort) with colour
    classes and form trend."""
    return stats.select(team, "win_rate", "season_point_diff",
                        rate_class(F.col("win_rate")).alias("win_rate_class"),
                        diff_class(F.col("season_point_diff")).alias("diff_class"),
                        form_label(F.col("recent_win_pct"), F.col("season_win_pct")).alias("form_trend")
                        ).orderBy(F.desc("win_rate"), F.col(team))


def team_outliers(stats: DataFrame) -> DataFrame:
    """P20: participants with |difference| > 8 or win rate outside [0.3, 0.7]."""
    d, r = F.col("season_point_diff"), F.col("win_rate")
    low, high = OUTLIER_RATES
    return stats.where((F.abs(d) > OUTLIER_DIFF) | (r > high) | (r < low))


def top_n(stats: DataFrame, by: str, n: int = 10, ascending: bool = False,
          tie: str = "team_name") -> DataFrame:
    """The ``n`` largest (or smallest) rows; planned as TakeOrderedAndProject."""
    o = F.col(by).asc() if ascending else F.col(by).desc()
    return stats.orderBy(o, F.col(tie)).limit(n)


def team_rankings(stats: DataFrame, n: int = 10, team: str = "team_name") -> DataFrame:
    """The four ranked lists (win rate, points, fewest allowed, difference), ``n`` rows each."""
    lists = [("win_rate", False), ("season_avg_pts", False), ("season_avg_pts_allowed", True),
             ("season_point_diff", False)]
    out = None
    for by, ascending in lists:
        first = top_n(stats.select(team, F.lit(by).alias("list"), F.col(by).alias("value")), "value", n, ascending, team)
        out = first if out is None else out.unionByName(first)
    signed = F.when(F.col("list") == "season_avg_pts_allowed", F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("list").orderBy(signed, team)  # at most n rows per list
    return out.withColumn("rank", F.row_number().over(w))


def games_per_day(games: DataFrame, date: str = "game_date") -> DataFrame:
    """Mean and max games per day (two-level aggregation)."""
    per_day = games.groupBy(F.to_date(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(F.count(F.lit(1)).alias("days"), F.avg("n").alias("avg_games_per_day"),
                       F.max("n").alias("max_games_per_day"))


def monthly_scoring(games: DataFrame, date: str = "game_date") -> DataFrame:
    """A7 + X6: monthly means of total, home and away points (rounded to 1)."""
    total = F.col("pts_home") + F.col("pts_away")
    return games.groupBy(F.trunc(date, "month").alias("month")).agg(
        F.bround(F.avg(total), 1).alias("avg_total_points"),
        F.bround(F.avg("pts_home"), 1).alias("avg_home_points"),
        F.bround(F.avg("pts_away"), 1).alias("avg_away_points"),
        F.count(F.lit(1)).alias("games"))


def home_advantage(games: DataFrame) -> DataFrame:
    """Home-win share and average totals."""
    h, a = F.col("pts_home"), F.col("pts_away")
    return games.agg(F.avg((h > a).cast("double")).alias("home_win_share"),
                     F.avg(h + a).alias("avg_total_points"), F.avg(h).alias("avg_home_points"),
                     F.avg(a).alias("avg_away_points"), F.avg(h - a).alias("avg_home_margin"))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric (and boolean) columns, minus an exclusion list."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in exclude]


def target_correlation(features: DataFrame, target: str = "target_win", exclude=("game_id",)) -> DataFrame:
    """A9 + T4: Pearson correlation of every numeric column with the target in
    one pass (pairwise-complete, as pandas), one row per feature."""
    cols = [c for c in numeric_columns(features, exclude) if c != target]
    t = F.col(target).cast("double")
    row = features.agg(*[_pearson(F.col(c).cast("double"), t).alias(c) for c in cols])
    stack = F.expr("stack({n}, {args}) as (feature, correlation)".format(
        n=len(cols), args=", ".join(f"'{c}', `{c}`" for c in cols)))
    return row.select(stack)


def ranked_correlation(corr: DataFrame, top: int = 15, bottom: int = 10) -> DataFrame:
    """T4: features by falling |correlation| (``rank`` from 1, an unknown correlation last), with
    ``part`` 'top' and 'bottom' for the first and last ones.  One row per feature."""
    w = Window.orderBy(F.abs("correlation").desc_nulls_last(), "feature")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    r = corr.withColumns({"rank": F.row_number().over(w), "_n": n})
    part = F.when(F.col("rank") <= top, "top").when(F.col("rank") > F.col("_n") - bottom, "bottom").otherwise("middle")
    return r.withColumn("part", part).drop("_n")


def _pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation over rows where both are there; NULL (no error) where one has no spread."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # partial variances may leave rounding
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def correlation_matrix(features: DataFrame, target: str = "target_win", exclude=("game_id",)) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, target included, in
    one pass: ``feature_a, feature_b, correlation`` with both orders and the diagonal.  A pair counts the
    rows in which neither is NULL; NULL where a column has no spread in them, else NaN where they hold
    a NaN or an infinity.

    An aggregate for every pair would make a plan that grows with the square of the columns.  Instead each
    task adds up five matrices (rows of both, sums and squares of one beside the other, products) over
    blocks of rows, and the sums of a pair are added by one aggregate.  Columns are shifted by their
    mean first, so that no digits are lost to large values."""
    cols = sorted(numeric_columns(features, exclude))
    x = features.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    n = len(cols)
    finite = [F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")) for c in cols]
    means = x.select(F.array(*[F.avg(v) for v in finite]).alias("m")).select("m").scalar()
    rows = x.select(F.array(*[F.col(f"`{c}`") for c in cols]).alias("v")).withColumn("m", means)

    def moments(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros((5, n, n))
        broken = np.zeros((n, n))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                flat = part.column(0).flatten()
                v = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, n)
                here = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n)
                shift = part.column(1).slice(0, 1).flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
                bad = here & ~np.isfinite(v)
                mask = (here & ~bad).astype(float)
                v = np.where(mask > 0, v - shift, 0.0)
                broken += bad.T.astype(float) @ here
                total += [mask.T @ mask, v.T @ mask, mask.T @ v, (v * v).T @ mask, v.T @ v]
        a, b = np.triu_indices(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array((broken + broken.T)[a, b]), *[pa.array(m[a, b]) for m in total],
             pa.array(total[3].T[a, b])], ["a", "b", "bad", "n", "sx", "sy", "sxx", "sxy", "syy"])

    names = ["bad", "n", "sx", "sy", "sxx", "sxy", "syy"]
    sums = rows.mapInArrow(moments, "a long, b long, " + ", ".join(f"{c} double" for c in names)).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in names])
    mx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    my = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    xy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    # what rounding leaves of a constant column is no spread
    spread = (mx > 1e-12 * F.col("sxx")) & (my > 1e-12 * F.col("syy"))
    value = F.when((F.col("n") > 1) & spread, F.when(F.col("bad") > 0, float("nan")).when(
        F.col("a") == F.col("b"), 1.0).otherwise(xy / F.sqrt(mx * my)))
    name = F.array(*map(F.lit, cols))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    cells = sums.select(F.explode(both).alias("p"), value.alias("correlation"))
    return cells.select(F.get(name, F.col("p.a").cast("int")).alias("feature_a"),
                        F.get(name, F.col("p.b").cast("int")).alias("feature_b"), "correlation")


def top_correlation_matrix(matrix: DataFrame, target: str = "target_win", n: int = 10) -> DataFrame:
    """The matrix of the ``n`` features with the largest |correlation| with the target, and the target."""
    own = matrix.where((F.col("feature_b") == target) & (F.col("feature_a") != target))
    names = top_n(own.select(F.col("feature_a").alias("feature"), F.abs("correlation").alias("_c")), "_c", n, tie="feature")
    names = names.select("feature").union(matrix.sparkSession.createDataFrame([(target,)], "feature string"))
    a, b = names.withColumnRenamed("feature", "feature_a"), names.withColumnRenamed("feature", "feature_b")
    return matrix.join(a, "feature_a", "left_semi").join(b, "feature_b", "left_semi")


def correlation_summary(corr: DataFrame) -> DataFrame:
    """A10: how many features correlate above 0.1 / below -0.1, and the strongest of each sign."""
    c = F.col("correlation")
    return corr.agg(F.count(F.when(c > 0.1, 1)).alias("n_positive"),
                    F.count(F.when(c < -0.1, 1)).alias("n_negative"),
                    F.max_by("feature", c).alias("strongest_positive"),
                    F.min_by("feature", c).alias("strongest_negative"),
                    F.max(c).alias("max_correlation"), F.min(c).alias("min_correlation"))


def missing_values(df: DataFrame) -> DataFrame:
    """NULL count per column and in total, in one pass."""
    cols = df.columns
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    stack = F.expr("stack({n}, {args}) as (column_name, missing)".format(
        n=len(cols), args=", ".join(f"'{c}', `{c}`" for c in cols)))
    return row.select(stack)
