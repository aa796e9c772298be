"""Plan shapes: no cross products anywhere, pre-shuffle limits in the windows."""

import pytest

from lineup.plans import catalog

catalog.load_all()
QUERIES = catalog.QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"model_scores", "model_metrics"}))
def test_no_cross_products(spark, small_dir, name):
    plan = _plan(QUERIES[name](spark, small_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name,scans,exchanges", [("features_final", 3, 6), ("rolling_form", 2, 3),
                                                  ("target_correlation", 3, 7), ("temporal_split", 6, 11),
                                                  ("cumulative_pnl", 4, 7), ("stake_quantiles", 5, 12),
                                                  ("accuracy_overall", 1, 1)])
def test_plan_sizes(spark, small_dir, name, scans, exchanges):
    plan = _plan(QUERIES[name](spark, small_dir)).split("== Initial Plan ==")[-1]
    assert "SortAggregate" not in plan or name != "accuracy_overall"
    assert plan.count("FileScan") <= scans and plan.count("Exchange hashpartitioning") + plan.count(
        "Exchange SinglePartition") + plan.count("Exchange rangepartitioning") <= exchanges


def test_a_hot_participant_is_spread(spark):
    from lineup.operators import windows as WN
    days = spark.range(4000).selectExpr("'hot' as team_name", "date_add(date'2000-01-01', cast(id as int)) as game_date",
                                        "1L as _n")
    b = WN.day_buckets(days, ["team_name"], "game_date", 10, 100)
    sizes = [r["count"] for r in b.groupBy("_bkt").count().collect()]
    assert len(sizes) == 40 and max(sizes) == 100
    copies = b.selectExpr("size(_to) - 1 as c").groupBy().sum().first()[0]
    assert copies == 39 * 10  # ten rows look ahead into each later bucket
