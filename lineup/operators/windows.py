"""Leak-free participant windows (W1-W7) that stay parallel on hot participants.

A participant (team, user, strategy) can hold a large share of all rows, so
partitioning a window by the participant alone would put that share into a
single task.  Instead each participant's history is cut into buckets of about
``bucket_rows`` rows, whole days each.  The cut comes from one small table, the
rows per (participant, day): it names for every day its bucket and the later
buckets whose first rows still look back at it.  Rows are joined to that table, copied to
those buckets (about ``n`` rows per bucket) and shuffled once by (participant, bucket);
row-frame windows of up to ``n`` preceding rows are then exact inside each bucket.

Whole-group quantities (season means, ranks, counts) are running sums over the same
day table and arrive with the same join.  Joins match NULLs: a row with a NULL participant,
season or date is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineup.config import FeatureConfig

UNB = Window.unboundedPreceding
#: Participant rows that one task sorts (``task_number``).
ROWS_PER_TASK = 250_000


def _match(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on ``cols``, NULLs equal; the right side gives its other columns."""
    right = right.withColumnsRenamed({c: f"_j_{c}" for c in cols})
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[f"_j_{c}"])
    return left.join(right, cond).drop(*[f"_j_{c}" for c in cols])


def task_number(rows: int, cores: int) -> int | None:
    """Into how many tasks ``rows`` participant rows should be dealt, so that one task sorts about
    ``ROWS_PER_TASK`` of them however many there are; None for few rows, which Spark may deal as it likes."""
    return None if rows <= 4 * ROWS_PER_TASK else max(cores, -(-rows // ROWS_PER_TASK))


def deal(rows: DataFrame, tasks: int | None) -> DataFrame:
    """``rows`` in ``tasks`` parts of the same number of rows; without it as they lie."""
    return rows.repartition(tasks) if tasks else rows


def _match_in(left: DataFrame, right: DataFrame, cols: list[str], tasks: int | None) -> DataFrame:
    """``_match`` in ``tasks`` tasks.  As fields of one struct NULLs are equal, and both sides can be dealt out by it."""
    if not tasks:
        return _match(left, right, cols)
    left = left.withColumn("_m", F.struct(*cols)).repartition(tasks, "_m")
    right = right.withColumn("_m", F.struct(*cols)).drop(*cols).repartition(tasks, "_m")
    return left.join(right, "_m").drop("_m")


def day_buckets(counts: DataFrame, keys: list[str], date: str, n: int, bucket_rows: int) -> DataFrame:
    """From rows per (keys, date) in ``_n``: ``_before`` (rows of earlier days), ``_bkt``,
    ``_start`` (rows before the bucket) and ``_to``, the bucket and those later ones whose first
    rows have some of this day's rows among their ``n`` predecessors.

    A day is never cut, so a bucket holds at least one day.  Of the following days only ``n``
    can start within ``n`` rows, so the look-ahead is a frame of ``n`` rows of this table.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    days = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(UNB, -1)), F.lit(0)))
    days = days.withColumn("_bkt", F.floor(F.col("_before") / bucket_rows).cast("long"))
    days = days.withColumn("_first", F.coalesce(F.lag("_bkt").over(w) != F.col("_bkt"), F.lit(True)))
    days = days.withColumn("_start", F.max(F.when(F.col("_first"), F.col("_before"))).over(w.rowsBetween(UNB, 0)))
    ahead = F.collect_list(F.struct("_first", "_before", "_bkt")).over(w.rowsBetween(1, n))
    near = F.filter(ahead, lambda d: d["_first"] & (d["_before"] < F.col("_before") + F.col("_n") + n))
    return days.withColumn("_to", F.concat(F.array("_bkt"), F.transform(near, lambda d: d["_bkt"]))).drop("_first")


def to_buckets(rows: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """One row per target bucket ``_w``; ``_carry`` marks the copies.  With ``tasks`` the buckets are dealt to as many."""
    out = rows.withColumn("_w", F.explode("_to")).drop("_to")
    out = out.repartition(tasks, *keys, "_w") if tasks else out
    return out.withColumn("_carry", F.col("_w") != F.col("_bkt"))


def lagged_mean(c: str, n: int, w) -> Column:
    """Mean of the ``n`` previous values; NULL unless all ``n`` are non-null
    (rolling mean of a shifted column with ``min_samples = n``).  The frame is computed on its own
    rows, so a NaN or a huge value reaches the ``n`` following rows and no others."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))


SEASON_MEASURES = (
    ("win_numeric", "season_win_pct"),
    ("pts_for", "season_avg_pts"),
    ("pts_against", "season_avg_pts_allowed"),
)


def _season_days(df: DataFrame, key: str, season: str, date: str, gid: str) -> DataFrame:
    """Per (participant, season, day): rows, sums and counts of the season measures before
    the day and over the season, and the measures of the season's last row."""
    aggs = [F.count(F.lit(1)).alias("_n"),
            F.max_by(F.struct(*[m for m, _ in SEASON_MEASURES]), gid).alias("_last")]
    for m, _ in SEASON_MEASURES:
        aggs += [F.sum(m).alias(f"_s_{m}"), F.count(m).alias(f"_c_{m}")]
    days = df.groupBy(key, season, date).agg(*aggs)
    whole = Window.partitionBy(key, season).orderBy(date)
    prev, every = whole.rowsBetween(UNB, -1), whole.rowsBetween(UNB, Window.unboundedFollowing)
    cols = {"_off_n": F.coalesce(F.sum("_n").over(prev), F.lit(0)),
            "_season_last": F.last("_last").over(every)}
    for m, _ in SEASON_MEASURES:
        for kind in ("s", "c"):
            cols[f"_off_{kind}_{m}"] = F.coalesce(F.sum(f"_{kind}_{m}").over(prev), F.lit(0))
            cols[f"_tot_{kind}_{m}"] = F.sum(f"_{kind}_{m}").over(every)
    return days.withColumns(cols).drop("_last", *[f"_{k}_{m}" for m, _ in SEASON_MEASURES for k in ("s", "c")])


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def participant_features(team_games: DataFrame, cfg: FeatureConfig = FeatureConfig(),
                         key: str = "team_name", season: str = "season_id",
                         date: str = "game_date", gid: str = "game_id",
                         whole_group: bool = True, tasks: int | None = None) -> DataFrame:
    """All window features of one participant row, computed in one partitioned pass.

    Adds the rolling means (``lookback`` and ``short``), the venue-split win
    rates as the reference computes them, ``games_played`` and
    ``games_played_asof``, ``rest_days`` (first game -> ``rest_default``),
    ``game_number_in_season`` (average rank of the date), and the season means
    both as-run (``season_*``: all but the season's last game) and leak-free
    (``season_*_asof``: previous games only).  Ties on the date are broken by
    ``gid``.  ``whole_group=False`` skips the whole-group values when only the
    row-frame features are needed.  ``tasks`` (see ``task_number``) is the number of tasks that the rows are
    dealt to; without it the session's shuffle partitions hold the more rows the more there are.
    """
    n_lb, n_sh = cfg.lookback, cfg.short
    df = team_games
    if whole_group:
        days = _season_days(df, key, season, date, gid)
        counts = days.groupBy(key, date).agg(F.sum("_n").alias("_n"))
    else:
        counts = df.groupBy(key, date).agg(F.count(F.lit(1)).alias("_n"))
    buckets = day_buckets(counts, [key], date, max(n_lb, n_sh), cfg.bucket_rows)
    if whole_group:
        # the whole history of a participant: rows of its last day and of all before
        total = F.max(F.col("_before") + F.col("_n")).over(Window.partitionBy(key))
        info = _match(days, buckets.withColumn("_team_n", total).withColumnRenamed("_n", "_day_n"), [key, date])
        u = to_buckets(_match_in(df, info, [key, season, date], tasks), [key], tasks)
    else:
        u = to_buckets(_match_in(df, buckets, [key, date], tasks), [key], tasks)

    w = Window.partitionBy(key, "_w").orderBy(date, gid)
    u = u.withColumn("_lag_win", F.lag("win_numeric").over(w))
    for side in ("home", "away"):
        u = u.withColumn(f"_v_{side}", F.when(F.col("venue") == F.lit(side), F.col("_lag_win")))
    cols: dict[str, Column] = {}
    for m, pattern in cfg.rolling_measures:
        cols[pattern.format(n=n_lb)] = lagged_mean(m, n_lb, w)
    for m, pattern in cfg.short_measures:
        cols[pattern.format(n=n_sh)] = lagged_mean(m, n_sh, w)
    frame = w.rowsBetween(-(n_lb - 1), 0)
    for side in ("home", "away"):
        v = f"_v_{side}"
        cols[f"{side}_win_pct_last_{n_lb}"] = F.when(F.count(v).over(frame) == n_lb, F.avg(v).over(frame))
    prev_date, prev_season = F.lag(date).over(w), F.lag(season).over(w)
    gap = F.datediff(F.col(date), prev_date)
    cols["rest_days"] = F.coalesce(gap, F.lit(cfg.rest_default))
    cols["rest_days_in_season"] = F.coalesce(F.when(prev_season == F.col(season), gap), F.lit(cfg.rest_default))
    if whole_group:
        cols["_rank"] = F.sum((~F.col("_carry")).cast("int")).over(w.rowsBetween(UNB, 0))
        today = Window.partitionBy(key, "_w", season, date).orderBy(gid).rowsBetween(UNB, -1)
        for m, _ in SEASON_MEASURES:
            cols[f"_run_s_{m}"] = F.coalesce(F.sum(m).over(today), F.lit(0))
            cols[f"_run_c_{m}"] = F.count(m).over(today)
    out = u.withColumns(cols).where(~F.col("_carry"))
    if whole_group:
        fin = {
            "games_played": F.col("_team_n") - 1,
            "games_played_asof": F.col("_start") + F.col("_rank") - 1,
            "game_number_in_season": F.col("_off_n") + (F.col("_n") + 1) / 2.0,
        }
        for m, name in SEASON_MEASURES:
            last = F.col(f"_season_last.{m}")
            fin[name] = _safe_div(
                F.col(f"_tot_s_{m}") - F.coalesce(last, F.lit(0)),
                F.col(f"_tot_c_{m}") - F.when(last.isNotNull(), 1).otherwise(0))
            fin[f"{name}_asof"] = _safe_div(
                F.col(f"_off_s_{m}") + F.col(f"_run_s_{m}"),
                F.col(f"_off_c_{m}") + F.col(f"_run_c_{m}"))
        out = out.withColumns(fin)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def venue_form(team_games: DataFrame, n: int = 10, key: str = "team_name",
               date: str = "game_date", gid: str = "game_id", bucket_rows: int = FeatureConfig.bucket_rows,
               measure: str = "win_numeric", tasks: int | None = None) -> DataFrame:
    """Win rate over the previous ``n`` games at the same venue: the useful
    form of the home/away split, partitioned by (participant, venue)."""
    keys = [key, "venue"]
    counts = team_games.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_n"))
    u = to_buckets(_match_in(team_games, day_buckets(counts, keys, date, n, bucket_rows), [*keys, date], tasks), keys, tasks)
    w = Window.partitionBy(*keys, "_w").orderBy(date, gid)
    out = u.withColumn("venue_win_pct_last_n", lagged_mean(measure, n, w)).where(~F.col("_carry"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


FINAL_COLUMNS = [
    "game_id", "game_date", "team_name", "opponent", "venue", "is_home", "target_win",
    "avg_pts_last_{n}", "avg_pts_allowed_last_{n}", "avg_point_diff_last_{n}", "win_pct_last_{n}",
    "win_pct_last_{s}", "avg_point_diff_last_{s}",
    "rest_days", "game_number_in_season",
    "season_win_pct", "season_avg_pts", "season_avg_pts_allowed",
]


def final_features(features: DataFrame, cfg: FeatureConfig = FeatureConfig(), keep=()) -> DataFrame:
    """History filter + model column list (P11, P12); ``keep`` names further columns to carry.

    As-run (``cfg.as_of=False``): ``games_played`` is a per-participant
    constant, so whole participants with too few games drop out and the season
    means include later games.  As-of: the filter drops each participant's
    first ``min_games`` rows and the season means use previous games only.
    """
    if cfg.as_of:
        gp = F.col("games_played_asof")
        features = features.withColumns({c: F.col(f"{c}_asof") for _, c in SEASON_MEASURES})
    else:
        gp = F.col("games_played")
    kept = features.where(gp >= cfg.min_games).withColumn("target_win", F.col("win"))
    wanted = [c.format(n=cfg.lookback, s=cfg.short) for c in FINAL_COLUMNS]
    return kept.select(*[c for c in [*wanted, *keep] if c in kept.columns])
