import hashlib
import random

import numpy as np
import pytest
import xxhash

from kinfold.llm import versions
from kinfold.llm.common import U64


def test_differences_are_recovered_at_any_size():
    r = np.random.default_rng(1)
    pairs = []
    for shared, a, b in ((0, 0, 0), (500, 0, 0), (300, 1, 0), (50, 5, 9), (0, 400, 3), (10, 3000, 2000), (5000, 40, 40)):
        k = r.integers(0, 2**63, shared + a + b, dtype=np.int64).view(U64)
        pairs.append((np.r_[k[:shared], k[shared : shared + a]], np.r_[k[shared + a :], k[:shared]]))
    for (a, b), (x, y) in zip(pairs, versions.differences(pairs)):
        assert set(x) == set(a) - set(b) and set(y) == set(b) - set(a)
    assert versions.likeness(pairs[:2]) == [1.0, 1.0]


def test_sets_are_compared_outright_past_the_last_size(monkeypatch):
    monkeypatch.setattr(versions, "LAST", 3)
    a, b = np.arange(1, 900, dtype=U64), np.arange(500, 2000, dtype=U64)
    ((x, y),) = versions.differences([(a, b)])
    assert set(x) == set(range(1, 500)) and set(y) == set(range(900, 2000))


def brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42), r[1]))
    out = []
    for i, (k, t) in enumerate(rows):
        f = rows[(i + 1) % len(rows)][1]
        e = versions.edited(t, f)
        a, b, c = (set(versions.cells(x.encode()).tolist()) for x in (t, e, f))
        near = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), versions.fingerprint(versions.cells(t.encode())), versions.fingerprint(versions.cells(e.encode())), *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 150])
def test_query_equals_brute_force(spark, n):
    rnd = random.Random(n)
    words = ["alpha", "beta", "Ünï", "日本語", "\U0001f600", "x", "the", "of"]
    rows = [(rnd.randrange(10**6), "".join(rnd.choice(words) + rnd.choice("  \n\t") for _ in range(rnd.choice([0, 1, 5, 80, 2000])))) for _ in range(n)]
    if n > 2:
        rows += [(None, "a b c"), (None, None), (-5, None), (7, ""), (7, ""), (7, "same same same same"), (8, rows[0][1]), (9, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as part", "3 as copy").repartition(5)
    got = sorted(map(tuple, versions.op8_query(df).collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_empty_table(spark):
    assert versions.op8_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edits_stay_nearer_than_other_documents(spark, sf_small):
    got = versions.op8_query(spark.read.parquet(f"{sf_small}/documents.parquet")).toPandas()
    long = got[got.n_chars > 200]
    assert (long.near_edited > long.near_next).mean() > 0.95
    assert long.near_edited.median() > 0.5 and long.near_next.median() < 0.1


def test_hot_and_null_keys_are_dealt(spark):
    """A third of the keys null, a third equal, some rows equal in all: many parts, and the order still holds."""
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(rnd.randint(0, 12)))
    rows = [(None, text()) for _ in range(300)] + [(50, text()) for _ in range(300)] + [(i, text()) for i in range(300)] + [(50, "the same text")] * 60 + [(None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = [r["count"] for r in versions.with_next(df).where("copy = 0").groupBy("part").count().collect()]
    assert max(sizes) < 150 and len(sizes) > 15
    got = sorted(map(tuple, versions.op8_query(df).collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    with pytest.raises(TypeError):
        versions.with_next(df.withColumn("doc_id", versions.F.lit("x")))
