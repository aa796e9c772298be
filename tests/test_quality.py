"""Checks that can fail, calendar gaps, correlations of many columns, file statistics."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineup.operators import analytics as A
from lineup.operators import quality as Q
from lineup.plans import catalog, derive

catalog.load_all()


def _games(spark, rows):
    return spark.createDataFrame([(g, dt.date(2024, 1, d), *t) for g, d, t in rows],
                                 "game_id int, game_date date, team_name_home string, team_abbreviation_home string, "
                                 "team_name_away string, team_abbreviation_away string")


def test_checks_can_fail(spark):
    home, away = ("Boston Celtics", "BOS"), ("Miami Heat", "MIA")
    games = _games(spark, [(1, 2, home + away), (1, 3, home + away), (2, 9, home + ("Miami", "MIA"))])
    teams = spark.createDataFrame([("BOS",), ("MIA",), ("LAL",)], "team string")
    feats = spark.createDataFrame([(dt.date(2024, 1, 3),)], "game_date date")

    def statuses(**kw):
        return {r.check: (r.value, r.status) for r in Q.data_quality(games, feats, None, teams, **kw).collect()}

    got = statuses()
    assert got == {"games_records": ("3", "ok"), "games_date_range": ("2024-01-02 .. 2024-01-09", "ok"),
                   "duplicate_games": ("1", "warn"), "teams_missing": ("1", "warn"), "team_names_inconsistent": ("1", "warn"),
                   "feature_records": ("1", "ok"), "latest_date": ("2024-01-03", "warn")}
    assert statuses(as_of=dt.date(2024, 1, 8))["games_date_range"][1] == "warn"  # a game after the day of the check
    empty = {r.check: r.status for r in Q.data_quality(games.limit(0), None, None, teams).collect()}
    assert empty["games_records"] == "empty" and empty["games_date_range"] == "warn" and empty["latest_date"] == "missing"
    late = spark.createDataFrame([(dt.date(2024, 1, 9),)], "game_date date")
    for day, want in ((dt.date(2024, 1, 12), "ok"), (dt.date(2024, 1, 30), "warn")):
        got = {r.check: r.status for r in Q.data_quality(games, late, None, teams, as_of=day).collect()}
        assert got["latest_date"] == want


def test_calendar_gaps(spark):
    day = lambda i: dt.date(2024, 1, i)
    rows = [("A", 1, day(i)) for i in range(1, 13)] + [("B", 1, day(i)) for i in (1, 2, 7, 8, 12)] + [("C", 2, day(20)), ("A", None, day(1))]
    df = spark.createDataFrame(rows, "team_name string, season_id int, game_date date")
    got = {tuple(r) for r in Q.calendar_gaps(df, 3).collect()}
    assert got == {("B", 1, day(3), day(6), 4), ("B", 1, day(9), day(11), 3)}
    fixed = {tuple(r) for r in Q.calendar_gaps(df, 1, teams=["A", "D"]).collect()}
    assert fixed == got | {("D", 1, day(1), day(12), 12), ("D", 2, day(20), day(20), 1), ("A", 2, day(20), day(20), 1)}
    plan = Q.calendar_gaps(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_data_quality_scans(spark, small_dir):
    plan = catalog.QUERIES["data_quality"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan") <= 8


def _wide(n_cols, n_rows=300):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((n_rows, 3))
    data = base @ rng.standard_normal((3, n_cols)) + rng.standard_normal((n_rows, n_cols)) + 1e6
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(n_cols)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.05)
    pdf["c1"] = 7.0
    pdf["c2"] = np.nan
    return pdf.astype(object).where(pdf.notna(), None)


def _table(df):
    return {(r.feature_a, r.feature_b): r.correlation for r in df.collect()}


def test_correlations_equal_pandas(spark):
    pdf = _wide(20)
    df = spark.createDataFrame(pdf, ", ".join(f"{c} double" for c in pdf.columns)).repartition(3)
    got = _table(A.correlation_matrix(df, exclude=()))
    want = pdf.astype(float).corr(min_periods=2)
    assert len(got) == 400
    for (a, b), v in got.items():
        w = None if {a, b} & {"c1", "c2"} else want.loc[a, b]  # a constant and an empty column
        assert v is None and w is None or v == pytest.approx(w, abs=1e-9), (a, b)
    bad = df.withColumn("c3", F.when(F.col("c4") > 1e6, float("nan")).otherwise(F.col("c3")))
    got = _table(A.correlation_matrix(bad, exclude=()))
    assert math.isnan(got["c3", "c5"]) and got["c1", "c3"] is None and got["c5", "c6"] == pytest.approx(want.loc["c5", "c6"])


def test_400_columns(spark):
    pdf = _wide(400, 60)
    df = spark.createDataFrame(pdf, ", ".join(f"{c} double" for c in pdf.columns))
    got = _table(A.correlation_matrix(df, exclude=()))
    assert len(got) == 400 * 400
    assert got["c10", "c390"] == pytest.approx(pdf["c10"].astype(float).corr(pdf["c390"].astype(float)), abs=1e-9)


def test_correlations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double, c int")
    assert set(_table(A.correlation_matrix(df, exclude=())).values()) == {None}


def test_target_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(i, 7.0, float(i), i % 2) for i in range(20)], "game_id int, a double, b double, target_win int")
    got = {r.feature: r.correlation for r in A.target_correlation(df).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(np.corrcoef(range(20), [i % 2 for i in range(20)])[0, 1])
