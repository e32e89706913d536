"""Joins and grouping on random signatures against brute force."""

import random

import pytest

from kinfold.functions.signatures import from_hex, group_id, to_hex
from kinfold.operators import grouping, selection, simjoin
from pyspark.sql import functions as F

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def d(a, b):
    return max(((a[0] ^ b[0]) & M).bit_count(), ((a[1] ^ b[1]) & M).bit_count())


def near(rnd, x, n):
    for _ in range(rnd.randrange(n)):
        x ^= 1 << rnd.randrange(64)
    return x


def sample(seed, n):
    rnd = random.Random(seed)
    bases = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(8)]
    rows = {}
    for i in range(n):
        p, q = rnd.choice(bases)
        rows[f"f{i:03d}"] = None if rnd.random() < 0.05 else (near(rnd, p, 9), near(rnd, q, 9)) if rnd.random() < 0.8 else (rnd.getrandbits(64), rnd.getrandbits(64))
    rows["same1"] = rows["same2"] = (5, 6)
    return rows


def frame(spark, rows, kind=None):
    data = [(k, kind or "asset", *(signed(x) for x in v)) if v else (k, kind or "asset", None, None) for k, v in rows.items()]
    return spark.createDataFrame(data, "path string, kind string, phash long, dhash long")


def components(rows, t=5):
    names = sorted(k for k, v in rows.items() if v)
    parent = {k: k for k in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in names:
        for b in names:
            if a < b and d(rows[a], rows[b]) <= t:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for k in names:
        out.setdefault(find(k), []).append(k)
    return {r: m for r, m in out.items() if len(m) > 1}


@pytest.mark.parametrize("t,phash_only", [(0, False), (5, False), (5, True), (10, False), (20, False), (20, True)])
def test_all_pairs(spark, t, phash_only):
    rows = sample(t, 90)
    known = {k: v for k, v in rows.items() if v}
    far = (lambda a, b: ((a[0] ^ b[0]) & M).bit_count()) if phash_only else d
    want = sorted((a, b, far(known[a], known[b])) for a in known for b in known if a < b and far(known[a], known[b]) <= t)
    got = simjoin.similar_pairs(frame(spark, rows), t, phash_only=phash_only)
    assert sorted(map(tuple, got.collect())) == want


def test_blocks_of_signatures(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", 20)
    rows = sample(3, 120)
    want = sorted((a, b) for a in rows for b in rows if a < b and rows[a] and rows[b] and d(rows[a], rows[b]) <= 15)
    assert sorted((r.a, r.b) for r in simjoin.similar_pairs(frame(spark, rows), 15).collect()) == want


def test_groups_from_scratch(spark):
    rows = sample(8, 120)
    got = {r.rep: list(r.files) for r in grouping.cold(frame(spark, rows)).collect()}
    assert got == components(rows)
    two = frame(spark, {"a": (1, 1), "b": (1, 1)}, "image").unionByName(frame(spark, {"c": (1, 1)}, "video"))
    (r,) = grouping.cold(two).collect()
    assert (r.files, r.kind, r.label) == (["a", "b"], "image", "exact")
    assert grouping.cold(two.limit(0)).count() == 0


def test_a_chain_is_one_group(spark):
    rows = {"a": (0, 0), "b": (15, 0), "c": (255, 0)}
    assert [r.files for r in grouping.cold(frame(spark, rows)).collect()] == [["a", "b", "c"]]


@pytest.mark.parametrize("seed", range(4))
def test_incremental_attach(spark, seed):
    rows = sample(seed, 70)
    rnd = random.Random(seed)
    new = sorted(k for k in rows if rnd.random() < 0.4)
    old = components({k: v for k, v in rows.items() if k not in new})
    home = {m: r for r, ms in old.items() for m in ms}
    seen = [k for k in rows if rows[k] and k not in new]
    for n in [k for k in new if rows[k]]:
        best = min(((d(rows[n], rows[m]), m) for m in seen if d(rows[n], rows[m]) <= 5), default=None)
        seen.append(n)
        if best:
            home.setdefault(best[1], best[1])
            home[n] = home[best[1]]
    want = {}
    for m, r in home.items():
        want.setdefault(r, set()).add(m)
    existing = spark.createDataFrame([(r, m) for r, ms in old.items() for m in ms] or [("", "")], "rep string, path string").where("rep <> ''")
    got = {}
    for r in grouping.incremental(frame(spark, rows), existing, spark.createDataFrame([(k,) for k in new], "path string")).collect():
        got.setdefault(r.rep, set()).add(r.path)
    assert got == {r: ms for r, ms in want.items() if len(ms) > 1}


def test_new_between_two_groups_keeps_them_apart(spark):
    rows = {"a1": (0, 0), "a2": (0, 0), "b": (7, 0), "c1": (255, 0), "c2": (255, 0)}
    old = spark.createDataFrame([("a1", "a1"), ("a1", "a2"), ("c1", "c1"), ("c1", "c2")], "rep string, path string")
    got = sorted(map(tuple, grouping.incremental(frame(spark, rows), old, spark.createDataFrame([("b",)], "path string")).collect()))
    assert got == [("a1", "a1"), ("a1", "a2"), ("a1", "b"), ("c1", "c1"), ("c1", "c2")]
    assert len(grouping.cold(frame(spark, rows)).collect()) == 1


def test_a_changed_file_leaves_its_group(spark):
    rows = {"a1": (0, 0), "a2": (M, M), "c1": (M, M)}
    old = spark.createDataFrame([("a1", "a1"), ("a1", "a2")], "rep string, path string")
    got = sorted(map(tuple, grouping.incremental(frame(spark, rows), old, spark.createDataFrame([("a2",)], "path string")).collect()))
    assert got == [("c1", "a2"), ("c1", "c1")]


def test_hex_and_group_id(spark):
    rows = [(signed(x), signed(y)) for x, y in [(0, M), (1 << 63, 5), (255, 1 << 62)]]
    df = spark.createDataFrame(rows, "p long, q long").withColumn("h", to_hex(F.col("p"), F.col("q")))
    a, b = from_hex(F.col("h"))
    assert all((r.p, r.q) == (r.a, r.b) and len(r.h) == 33 for r in df.select("*", a.alias("a"), b.alias("b")).collect())
    a, b = from_hex(F.col("x"))
    odd = spark.createDataFrame([("00000000000000ff",), ("zz|1",), (None,)], "x string").select(a.alias("a"), b.alias("b")).collect()
    assert [tuple(r) for r in odd] == [(255, 255), (None, 1), (None, None)]
    one = spark.range(1).select(group_id(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("x"), group_id(F.array(F.lit("a"), F.lit("b"))).alias("y")).first()
    assert one.x == one.y and len(one.x) == 8


def test_best_and_exact(spark):
    rows = [("g", "a", 240, 240, 900, 0.0), ("g", "b", 240, 240, 900, 0.0), ("g", "c", 120, 120, 300, 0.0), ("h", "d", 10, 10, 5, 0.0), ("h", "e", 10, 10, 5, 0.0), ("k", "x", None, None, 7, 0.0), ("k", "y", None, None, 7, 0.0)]
    df = spark.createDataFrame(rows, "rep string, path string, width int, height int, size long, duration double")
    judged = selection.with_exact(selection.ranked(df))
    act, stay = selection.eliminate(judged)
    assert sorted(map(tuple, act.collect())) == [("g", "b", "a"), ("h", "e", "d")]
    assert sorted((r.rep, r.path) for r in stay.collect()) == [("g", "a"), ("g", "c"), ("k", "x"), ("k", "y")]
    out = selection.result_groups(judged.withColumn("group_id", F.col("rep"))).where("group_id = 'g'").first()
    assert out.best_file.path == "a" and out.best_file.resolution.label == "240x240"
    assert [(x.path, x.is_exact_match, x.resolution.label) for x in out.duplicate_files] == [("b", True, "240x240"), ("c", False, "120x120")]


def test_best_video(spark):
    rows = [("g", "a", 640, 480, 10, 3.0), ("g", "b", 640, 480, 10, 9.0), ("g", "c", 640, 480, 11, 9.0), ("g", "d", 480, 640, 99, 99.0), ("g", "e", 320, 240, 99, 99.0)]
    df = spark.createDataFrame(rows, "rep string, path string, width int, height int, size long, duration double")
    assert selection.ranked(df, video=F.lit(True)).where("is_best").first().path == "c"
    assert selection.ranked(df).where("is_best").first().path == "a"


def test_equal_assets_attach_in_linear_time(spark):
    """20 000 equal assets, half of them new, and a few near ones: as many rows as assets, not as pairs."""
    from kinfold.operators import simjoin
    from kinfold.runtime import materialize

    same = spark.range(20_000).selectExpr("id as path", "'x' as kind", "5L as phash", "9L as dhash")
    near = spark.range(20_000, 20_010).selectExpr("id as path", "'x' as kind", "7L as phash", "9L as dhash")
    sigs = materialize(same.unionAll(near))
    got = {r.path: (r.near, r.distance) for r in simjoin.nearest(sigs, sigs).collect()}
    assert got[0] == (1, 0) and all(got[i] == (0, 0) for i in range(1, 20_000)) and got[20_000] == (20_001, 0) and got[20_005] == (20_000, 0)
    out = grouping.incremental(sigs, sigs.where("path < 2").selectExpr("0L as rep", "path"), sigs.where("path >= 2").select("path")).collect()
    assert len(out) == 20_010 and {r.rep for r in out} == {0}
