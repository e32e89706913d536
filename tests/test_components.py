import random

import pytest

from kinfold.operators import components
from kinfold.operators.components import connected_components


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5), (None, 3), (4, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_joins_of_a_round_are_not_broadcast(spark, monkeypatch):
    plans, keep = [], components.materialize

    def seen(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *a)

    monkeypatch.setattr(components, "materialize", seen)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    assert {r.component for r in connected_components(keep(edges), "src", "dst").collect()} == {0}
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_stars_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_ROUNDS", 0)
    edges = spark.createDataFrame([(0, 1), (0, 2), (7, 3), (2, 0)], "src long, dst long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (7, 3)}
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
