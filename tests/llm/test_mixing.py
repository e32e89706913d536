import random
import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from kinfold.llm import mixing


def reshared(sizes):
    """Targets as the contract words them: split, stop at the limit, split the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        all_ = sum(w[s] for s in open_)
        share = {s: left * w[s] / all_ for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def corpus(n, sources):
    rnd = random.Random(n)
    return [(i, " ".join("w" for _ in range(rnd.choice([1, 3, 40, 200]))) + " \t x", rnd.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("rows", [
    corpus(600, ["a", "b", "c", "d", None, "hot", "hot", "hot", "hot", "Ä", "n", "s"]),
    [(1, "a b", "x"), (2, "c", "x"), (3, "e", "y")],
    [(None, "a b", "x"), (None, "c", "x"), (2, None, "y"), (3, "", None), (3, "", None), (7, "w w", "x"), (7, "w w", "x")],
    [(1, None, "x"), (2, "", "y")],
])
def test_query_meets_targets_and_sql(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as h", "3 as s", "4 as threshold")
    got = mixing.op5_query(df).toPandas()
    sizes, own, largest, taken = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        own.setdefault((i, n), s)
        largest[s] = max(largest[s], n)
    want = reshared(sizes)
    for r in got.itertuples():
        s = own[None if pd.isna(r.doc_id) else int(r.doc_id), r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    c = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    c.execute("create table documents as select * from documents")
    key = lambda r: tuple(str(x) for x in r)
    sql = sorted(((None if r[0] is None else r[0], *r[1:]) for r in c.execute(mixing.OP5_SQL).fetchall()), key=key)
    assert sorted((tuple(r) for r in mixing.op5_query(df).collect()), key=key) == sql


def test_mix_repeats_rows(spark):
    rows = corpus(300, ["a", "b", "c", None])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id as h", "1 as `a.b`")
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.op5_query(df).collect():
        assert r.taken == r.size * times.get(r.doc_id, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.op5_query(df).count() == mixing.mix_sources(df).count() == 0


def test_null_and_repeated_keys_meet_the_target(spark):
    """Two thirds of the keys are null, some repeated, and one row comes 400 times: still within 1 % of the target."""
    rnd = random.Random(8)
    words = lambda: " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 20)))
    rows = [(None, words(), "x") for _ in range(600)] + [(i % 50, words(), "x") for i in range(300)] + [(None, "same words here", "x")] * 400 + [(9_000 + i, words(), "y") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.op5_query(df).toPandas()
    x = got[got.source_size == sum(len(t.split()) for _, t, s in rows if s == "x")]
    assert len(x) == 1_300 and abs(x.taken.sum() - x.target.iloc[0]) <= 0.01 * x.target.iloc[0]
    again = mixing.op5_query(df.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    mixed = mixing.mix_sources(df.withColumn("h", mixing.F.lit(1)))
    assert mixed.columns == ["doc_id", "text", "source", "h"]
    assert abs(sum(len(r.text.split()) for r in mixed.where("source = 'x'").collect()) - x.target.iloc[0]) <= 0.01 * x.target.iloc[0]
