"""As-of join against a plain loop; a hot key; plan shape."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lineup.operators import markets as M
from lineup.operators.asof import asof_join

T0 = dt.datetime(2024, 1, 1)
LEFT, RIGHT = "k string, t timestamp, id int, _v int", "k string, at timestamp, seq int, v int"


def _rows(rng, n, keys=("a", "b", None)):
    return [(rng.choice(keys), None if rng.random() < 0.05 else T0 + dt.timedelta(hours=rng.randrange(200)), i,
             rng.choice([None, *range(9)])) for i in range(n)]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("slot", [F.to_date, lambda t: F.date_trunc("hour", t), lambda t: F.lit(1)])
def test_asof_equals_a_loop(spark, strict, slot):
    rng = random.Random(7)
    left, right = _rows(rng, 150), _rows(rng, 120)
    got = {r.id: (r.seq, r.v) for r in asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"],
                                                 "t", "at", ["seq", "v"], strict, "seq", slot).collect()}
    assert len(got) == len(left)
    for k, t, i, _ in left:
        before = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None
                  and (r[1] < t or not strict and r[1] == t)]
        best = max(before, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        assert got[i] == best[2:], (k, t, i)


def test_asof_empty_sides_and_columns(spark):
    left, right = spark.createDataFrame(_rows(random.Random(1), 5), LEFT), spark.createDataFrame([], RIGHT)
    out = asof_join(left, right, ["k"], "t", "at", ["seq"])
    assert out.columns == ["k", "t", "id", "_v", "seq"] and {r.seq for r in out.collect()} == {None} and out.count() == 5
    assert asof_join(left.limit(0), right, ["k"], "t", "at", ["seq"]).count() == 0


def test_a_hot_key_is_cut_into_slots(spark):
    """All rows share one key: no window over rows is partitioned by the key alone."""
    left = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 600 + 300).alias("t"), "id")
    right = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 600).alias("at"),
                                       F.col("id").alias("seq"))
    out = asof_join(left, right, ["k"], "t", "at", ["seq"])
    assert out.where("seq = id").count() == 20_000
    per_task = left.groupBy(F.to_date("t")).count().agg(F.max("count")).first()[0]
    assert per_task == 144  # what one window partition holds of each table
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and plan.count("Exchange hashpartitioning(_k0") <= 3 * 2


def test_closing_odds(spark):
    s = spark.createDataFrame([("g1", T0), ("g2", T0), ("g3", T0)], "game_id string, commence_time timestamp")
    h = dt.timedelta(hours=1)
    q = spark.createDataFrame([("g1", "b", T0 - 3 * h, 2.0, 2.0), ("g1", "b", T0 - h, 3.0, None), ("g1", "b", T0, 9.0, 9.0),
                               ("g1", "c", T0 - 2 * h, 4.0, 4.0), ("g2", "b", T0 + h, 5.0, 5.0)],
                              "game_id string, bookmaker string, snapshot_ts timestamp, home_odds double, away_odds double")
    got = {r.game_id: (r.home_odds, r.away_odds, r.n_books, r.last_seen) for r in M.closing_odds(s, q).collect()}
    assert got == {"g1": (3.5, 4.0, 2, T0 - h), "g2": (None, None, 0, None), "g3": (None, None, None, None)}


def test_closing_join_takes_the_quotes_from_their_documents_once(spark, small_dir):
    from lineup.plans.q_markets import closing_odds_join
    plan = closing_odds_join(spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_get" not in plan and "parseJson" not in plan
