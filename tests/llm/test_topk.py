import duckdb
import numpy as np
import pytest

from kinfold.llm import topk


def brute(rows, k=20, every=20):
    seen = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(64 * float(x))) for x in v]
        seen[i] = min(seen.get(i, w), w)
    out = []
    for q in seen:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(seen[q], seen[c])), c) for c in seen if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block,group,stretch", [(4096, 8192, 8192), (7, 50, 60)])
def test_query_equals_brute_force(spark, monkeypatch, block, group, stretch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "GROUP_ROWS", group)
    r = np.random.default_rng(4)
    v = (r.normal(size=(400, 8)) / 3).astype(np.float32).tolist()
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(400 + i, v[3]) for i in range(120)] + [(-40, [0.0] * 8), (-20, v[3]), (-20, v[3]), (-20, v[5])]
    rows += [(None, v[0]), (1000, None), (1020, [None] + v[0][1:]), (1040, [float("nan")] + v[0][1:]), (1060, [float("inf")] + v[0][1:]), (1080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as score", "3 as rank")
    got = topk.op10_query(df)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert topk.op10_query(df.limit(0)).count() == 0
    few = df.where("vec_id between 0 and 4")
    assert sorted(map(tuple, topk.op10_query(few).collect())) == brute(rows[:5])


def test_reading_stops_on_proof_only():
    r = np.random.default_rng(5)
    v = np.floor(r.normal(size=(3000, 4)) * 100).astype(np.int64)
    v[:40] *= 30
    index, q = topk.segments(v), v[5:25]
    assert (sum(p for p, _ in index) == v).all()
    i, j = topk.candidates(q, index, np.full(len(q), -np.inf), 10)
    exact = q @ v.T
    for a in range(len(q)):
        assert set(np.argsort(-exact[a])[:10]) <= set(j[i == a])


def test_sql_gives_the_same(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{d}/embeddings.parquet')")
    want = sorted(c.execute(topk.OP10_SQL).fetchall())
    assert sorted(map(tuple, topk.op10_query(spark.read.parquet(f"{d}/embeddings.parquet")).collect())) == want
