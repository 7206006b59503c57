"""Tables of all markers are joined by merging, however small their files look."""

import pytest

from titerloom.plans import registry


@pytest.mark.parametrize("name", ["rename_results", "merge_results"])
def test_markers_are_not_broadcast(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # rename_results joins nothing else; merge_results also aggregates of its requests.
    assert plan.count("SortMergeJoin") >= (5 if name == "rename_results" else 2)
    assert name != "rename_results" or "BroadcastHashJoin" not in plan
