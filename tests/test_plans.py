"""Plan checks: top-k plans a partial limit before the shuffle; no pair-producing joins."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.write.format("noop").mode("overwrite").save()          # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["recent_commits", "call_sites", "vector_knn"])
def test_topk_has_partial_window_limit(spark, name):
    from packtables.operators.history import recent_commits
    from packtables.plans import registry as R

    if name == "recent_commits":
        fx = R.fixture(spark, SF)
        df = recent_commits(fx.commits, fx.commit_files, 5)
    else:
        df = E.queries()[name](spark, SF)
    assert "WindowGroupLimit" in _plan(df)


def test_no_nested_loop_or_cartesian(spark):
    for name, f in E.queries().items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
