"""Plans of the similarity joins: what has a row for each pair of fields is never built as one relation on the driver."""

import re

import pytest
from pyspark.sql import functions as F

from kinfold.operators import grouping, simjoin
from kinfold.runtime import materialize

SIGS = [(i, "asset", i << 40 | i, i << 20 | 3 * i) for i in range(40)]


def broadcast_on_fields(df) -> list[str]:
    """Broadcast joins of ``df`` on the fields of the hashes."""
    return re.findall(r"Broadcast\w*Join [^\n]*\bpf#", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def sigs(spark):
    return materialize(spark.createDataFrame(SIGS, "path long, kind string, phash long, dhash long"))


@pytest.mark.parametrize("t", [4, 5, 10])
def test_filed_signatures_are_not_broadcast(sigs, t):
    assert not broadcast_on_fields(simjoin.signature_pairs(sigs, t))
    assert not broadcast_on_fields(simjoin.similar_pairs(sigs, t))
    assert not broadcast_on_fields(simjoin.signature_pairs(sigs, t, phash_only=True))
    assert not broadcast_on_fields(simjoin.nearest(sigs.where("path % 2 = 1"), sigs.where("path % 2 = 0"), t))


def test_groups_stay_the_same_without_broadcast(spark, sigs):
    want = {(r.rep, r.path) for r in grouping.members(sigs).collect()}
    near = lambda a, b: max((a[2] ^ b[2]).bit_count(), (a[3] ^ b[3]).bit_count()) <= 5
    part = {s[0]: s[0] for s in SIGS}
    for _ in SIGS:
        for a in SIGS:
            part[a[0]] = min(part[b[0]] for b in SIGS if near(a, b))
    sizes = [list(part.values()).count(part[s[0]]) for s in SIGS]
    assert want == {(part[s[0]], s[0]) for s, n in zip(SIGS, sizes, strict=True) if n > 1}


def test_pairs_of_a_large_group_are_listed_by_many_tasks(spark):
    rows = [(i, "asset", 7, i % 9) for i in range(2000)] + [(5000 + i, "asset", 1 << 50 + i | 7, 1) for i in range(3)] + [(None, "asset", 7, 1)]
    sigs = materialize(spark.createDataFrame(rows, "path long, kind string, phash long, dhash long"))
    pairs = materialize(simjoin.similar_pairs(sigs, phash_only=True).withColumn("task", F.spark_partition_id()))
    n = 2000 * 1999 // 2 + 3 * 2000 + 3
    assert pairs.count() == pairs.where("a < b").select("a", "b").distinct().count() == n
    assert {r.distance: r["count"] for r in pairs.groupBy("distance").count().collect()} == {0: 2000 * 1999 // 2, 1: 3 * 2000, 2: 3}
    assert max(r["count"] for r in pairs.groupBy("task").count().collect()) < n // 2
