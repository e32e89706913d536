"""The queries on groups send nothing that grows with the input through the driver."""

import pytest

from kinfold.operators import components, grouping
from kinfold.plans import catalogue, stores

QUERIES = ["exact_elimination", "group_ids", "group_labels", "grouping_diff", "kind_groups", "folder_summary", "group_best", "group_kind_counts", "group_members_exact_flag", "groups_without_file"]


@pytest.mark.parametrize("name", QUERIES)
def test_nothing_of_groups_is_broadcast(spark, sf_small, monkeypatch, name):
    plans, keep = [], components.materialize

    def seen(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *a)

    for module in (components, grouping, catalogue, stores):
        monkeypatch.setattr(module, "materialize", seen)
    seen(catalogue.QUERIES[name](spark, sf_small))
    assert len(plans) > 2 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
