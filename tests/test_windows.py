"""Participant windows: split partitions with carried rows equal a direct
per-participant computation, NULL rules, and leak-freedom of as-of features."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineup.config import FeatureConfig
from lineup.operators import windows as WN

COLS = ("game_id long, game_date date, season_id int, team_name string, venue string, pts_for int, "
        "pts_against int, win boolean, fg_pct double, fg3_pct double, ft_pct double, rebounds int, "
        "assists int, turnovers int, point_diff int, win_numeric double, is_home boolean")


def _fixture():
    """Teams with 3, 10, 11 and 60 games; two games on one date; NULL measures;
    season changes; gaps across months."""
    rng = np.random.default_rng(7)
    rows, gid = [], 0
    for team, n in (("T3", 3), ("T10", 10), ("T11", 11), ("T60", 60)):
        d = dt.date(2019, 10, 20)
        for i in range(n):
            d = d + dt.timedelta(days=int(rng.integers(0, 9)))  # 0 -> same date twice
            gid += 1
            pf, pa = int(rng.integers(80, 130)), int(rng.integers(80, 130))
            fg3 = None if (team == "T60" and i in (20, 21)) else float(rng.integers(300, 450)) / 1000
            season = d.year if d.month >= 10 else d.year - 1
            venue = "home" if rng.random() < 0.5 else "away"
            rows.append((gid, d, season, team, venue, pf, pa, pf > pa, float(rng.integers(400, 550)) / 1000,
                         fg3, 0.75, int(rng.integers(30, 55)), int(rng.integers(15, 35)), int(rng.integers(8, 20)),
                         pf - pa, float(pf > pa), venue == "home"))
    return rows


def _expected(pdf: pd.DataFrame, n: int = 10, s: int = 5) -> pd.DataFrame:
    pdf = pdf.sort_values(["team_name", "game_date", "game_id"]).copy()
    g = pdf.groupby("team_name", sort=False)
    out = pdf[["game_id", "team_name"]].copy()
    for m, pat in FeatureConfig().rolling_measures:
        out[pat.format(n=n)] = g[m].transform(lambda x: x.shift(1).rolling(n, min_periods=n).mean())
    for m, pat in FeatureConfig().short_measures:
        out[pat.format(n=s)] = g[m].transform(lambda x: x.shift(1).rolling(s, min_periods=s).mean())
    lag_win = g["win_numeric"].shift(1)
    for side in ("home", "away"):
        v = lag_win.where(pdf["venue"] == side)
        out[f"{side}_win_pct_last_{n}"] = v.groupby(pdf["team_name"]).transform(
            lambda x: x.rolling(n, min_periods=n).mean())
    out["games_played"] = g["game_id"].transform(lambda x: x.shift(1).count())
    out["games_played_asof"] = g.cumcount()
    prev = g["game_date"].shift(1)
    out["rest_days"] = (pd.to_datetime(pdf["game_date"]) - pd.to_datetime(prev)).dt.days.fillna(2).astype(int)
    gs = pdf.groupby(["team_name", "season_id"], sort=False)
    prev_s = gs["game_date"].shift(1)
    out["rest_days_in_season"] = (pd.to_datetime(pdf["game_date"]) - pd.to_datetime(prev_s)).dt.days \
        .fillna(2).astype(int)
    out["game_number_in_season"] = gs["game_date"].rank(method="average")
    for m, name in WN.SEASON_MEASURES:
        out[name] = gs[m].transform(lambda x: x.shift(1).mean())
        out[f"{name}_asof"] = gs[m].transform(lambda x: x.shift(1).expanding().mean())
    return out


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 25, 100_000])
def test_split_windows_equal_direct(spark, rows_per_bucket):
    rows = _fixture()
    df = spark.createDataFrame(rows, COLS)
    got = WN.participant_features(df, FeatureConfig(bucket_rows=rows_per_bucket)).toPandas()
    exp = _expected(pd.DataFrame(rows, columns=[c.split()[0] for c in COLS.split(", ")]))
    got = got.set_index("game_id").sort_index()
    exp = exp.set_index("game_id").sort_index()
    assert len(got) == len(exp)
    for c in exp.columns:
        if c == "team_name":
            continue
        a, b = got[c].astype(float).to_numpy(), exp[c].astype(float).to_numpy()
        assert np.allclose(a, b, equal_nan=True), c


def test_null_and_history_rules(spark):
    rows = _fixture()
    got = WN.participant_features(spark.createDataFrame(rows, COLS)).toPandas()
    t3 = got[got.team_name == "T3"]
    assert t3["avg_pts_last_10"].isna().all()          # fewer than N games
    t11 = got[got.team_name == "T11"].sort_values(["game_date", "game_id"])
    assert t11["avg_pts_last_10"].notna().sum() == 1    # exactly the 11th game
    first = got.sort_values(["game_date", "game_id"]).groupby("team_name").head(1)
    assert (first["rest_days"] == 2).all()
    # games_played is a per-team constant (as-run), so the filter drops whole teams
    ff = WN.final_features(WN.participant_features(spark.createDataFrame(rows, COLS)), FeatureConfig())
    assert "T3" not in {r.team_name for r in ff.select("team_name").distinct().collect()}
    asof = WN.final_features(WN.participant_features(spark.createDataFrame(rows, COLS),
                                                     FeatureConfig(as_of=True)), FeatureConfig(as_of=True))
    assert asof.where("team_name = 'T3'").count() == 0 and asof.where("team_name = 'T60'").count() == 57


def test_asof_features_do_not_leak(spark):
    rows = _fixture()
    base = WN.participant_features(spark.createDataFrame(rows, COLS), FeatureConfig(as_of=True))
    last = max(r[0] for r in rows if r[3] == "T60")
    changed = [r if r[0] != last else r[:5] + (200, 50) + r[7:] for r in rows]
    alt = WN.participant_features(spark.createDataFrame(changed, COLS), FeatureConfig(as_of=True))
    cols = ["avg_pts_last_10", "season_avg_pts_asof", "win_pct_last_5", "games_played_asof"]
    a = base.where(F.col("game_id") != last).select("game_id", *cols).toPandas().set_index("game_id").sort_index()
    b = alt.where(F.col("game_id") != last).select("game_id", *cols).toPandas().set_index("game_id").sort_index()
    pd.testing.assert_frame_equal(a, b)
    # the as-run season mean of earlier rows does see a later game (all but the season's last)
    games = sorted((r[1], r[0]) for r in rows if r[3] == "T60" and r[2] == 2019)
    mid = games[len(games) // 2][1]
    changed = [r if r[0] != mid else r[:5] + (200, 50) + r[7:] for r in rows]
    alt = WN.participant_features(spark.createDataFrame(changed, COLS), FeatureConfig(as_of=True))
    first = games[0][1]
    ar, br = (d.where(F.col("game_id") == first).select("season_avg_pts", "season_avg_pts_asof").first() for d in (base, alt))
    assert ar.season_avg_pts != br.season_avg_pts and ar.season_avg_pts_asof == br.season_avg_pts_asof


def test_venue_form_equals_direct(spark):
    rows = _fixture()
    df = spark.createDataFrame(rows, COLS)
    got = WN.venue_form(df, 3).toPandas().set_index("game_id").sort_index()
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in COLS.split(", ")]).sort_values(
        ["team_name", "game_date", "game_id"])
    exp = pdf.groupby(["team_name", "venue"])["win_numeric"].transform(
        lambda x: x.shift(1).rolling(3, min_periods=3).mean())
    exp.index = pdf["game_id"]
    assert np.allclose(got["venue_win_pct_last_n"].to_numpy(), exp.sort_index().to_numpy(), equal_nan=True)


def test_nan_inf_and_large_values_stay_in_their_frames(spark):
    rows = []
    for r in _fixture():
        bad = {130 - 100 + 10: float("nan"), 50: float("inf"), 60: 1e15}.get(r[0])
        rows.append(r[:8] + (bad,) + r[9:] if bad is not None else r)
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in COLS.split(", ")]).sort_values(["team_name", "game_date", "game_id"])
    results = []
    for size in (3, 20, 100_000):
        got = WN.participant_features(spark.createDataFrame(rows, COLS), FeatureConfig(bucket_rows=size),
                                      whole_group=False).toPandas().set_index("game_id").sort_index()
        results.append(got["avg_fg_pct_last_10"].to_numpy())
    for r in results[1:]:
        assert np.array_equal(r, results[0], equal_nan=True)
    by_id = dict(zip(got.index, results[0]))
    for _, g in pdf.groupby("team_name"):
        v, ids = g["fg_pct"].to_numpy(), g["game_id"].to_numpy()
        for i in range(10, len(v)):
            frame = v[i - 10:i]
            if np.isfinite(frame).all():
                assert by_id[ids[i]] == pytest.approx(frame.mean(), rel=1e-12)
            else:
                assert not np.isfinite(by_id[ids[i]])


def test_null_keys_keep_their_rows(spark):
    rows = _fixture()
    rows[5] = rows[5][:2] + (None,) + rows[5][3:]
    rows[9] = (rows[9][0], None) + rows[9][2:]
    rows[20] = rows[20][:3] + (None,) + rows[20][4:]
    df = spark.createDataFrame(rows, COLS)
    for whole in (True, False):
        got = WN.participant_features(df, FeatureConfig(bucket_rows=4), whole_group=whole)
        assert sorted(r.game_id for r in got.select("game_id").collect()) == sorted(r[0] for r in rows)
    assert WN.venue_form(df, 3, bucket_rows=4).count() == len(rows)


def test_rows_are_dealt_to_tasks_by_their_number(spark, small_dir, monkeypatch):
    """Same rows, NULL keys and dates as well, and more tasks for more rows."""
    import datetime as dt

    from lineup.operators import windows as W
    from lineup.plans import q_features as Q
    rows = [(g, None if g % 11 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=g // 4), None if g % 13 == 0 else 2020 + g // 100,
             [None, "a", "b"][g % 3], ["home", "away"][g % 2], g % 7, g % 5, float(g % 2), bool(g % 2)) for g in range(200)]
    df = spark.createDataFrame(rows, "game_id int, game_date date, season_id int, team_name string, venue string, pts_for int, "
                                     "pts_against int, win_numeric double, win boolean")
    for c in ("point_diff", "fg_pct", "fg3_pct", "ft_pct", "rebounds", "assists", "turnovers"):
        df = df.withColumn(c, df.pts_for - df.pts_against)
    for whole in (True, False):
        a, b = (W.participant_features(df, whole_group=whole, tasks=t) for t in (None, 7))
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert len(a.collect()) == 200
    a, b = (W.venue_form(df, 3, tasks=t) for t in (None, 7))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert W.task_number(10 * W.ROWS_PER_TASK + 1, 4) == 11 and W.task_number(100, 4) is None
    n = Q.team_rows(spark, small_dir).count()
    monkeypatch.setattr(W, "ROWS_PER_TASK", -(-n // 23))
    plan = Q.features_final_asof(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 23), REPARTITION_BY_NUM") == 3  # both sides of the join, the buckets
