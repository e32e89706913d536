import hashlib
import random
import re

import numpy as np

from kinfold.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, words):
        if k is not None:
            for i in range(len(w) - window + 1):
                x = tuple(w[i : i + window])
                first[x] = min(first.get(x, k), k)
    out = []
    for (k, _), w in zip(rows, words):
        gone = set()
        if k is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < k:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(rnd, n, size, pool):
    """Texts with shared passages of many lengths, edits, cuts, runs of one word, copies and odd white space."""
    shared = [[rnd.choice(pool) for _ in range(rnd.randrange(3, 3 * size))] for _ in range(5)]
    rows = [(None, "a b " * 99), (1, None), (2, ""), (3, " \t"), (4, "w"), (5, "x " * 300), (6, "y x " * 5 + "x " * 200), (6, "y x " * 5 + "x " * 200)]
    for i in range(n):
        t = []
        for _ in range(rnd.randrange(1, 5)):
            p = list(rnd.choice(shared)) if rnd.random() < 0.6 else [rnd.choice(pool) for _ in range(rnd.randrange(2 * size))]
            if rnd.random() < 0.5 and p:
                p[rnd.randrange(len(p))] = "edit%d" % rnd.randrange(9)
            a = rnd.randrange(len(p) + 1)
            t += p[a:] if rnd.random() < 0.3 else p
        rows.append((10 + i, "".join(w + rnd.choice([" ", " ", "\n", "\t ", " "]) for w in t)))
        if rnd.random() < 0.2:
            rows.append((1000 - i, rows[-1][1]))
    return rows


def test_query_equals_brute_force(spark):
    rnd = random.Random(11)
    for size, window in ((8, 5), (120, 50)):
        rows = corpus(rnd, 60, size, ["w%d" % i for i in range(12 if window == 5 else 500)] + ["é", "ß z"])
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as spans")
        if window == 50:
            got = substrings.op6_query(df).collect()
            assert sorted(map(tuple, got), key=str) == brute(rows, 50)
        else:
            got = substrings.duplicate_spans(df, window=5, gram=2).collect()
            assert sorted(((r.doc_id, r.n_words, sum(s.words for s in r.spans), hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str) == brute(rows, 5)
    assert substrings.op6_query(df.limit(0)).count() == 0


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 60)
    for n in (1, 2, 3, 7, 39, 60):
        assert (substrings.sliding_min(x, n) == [x[i : i + n].min() for i in range(61 - n)]).all()


def test_sql_gives_the_same(spark, sf_small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_small}/documents.parquet')")
    want = sorted(con.execute(substrings.OP6_SQL).fetchall())
    got = substrings.op6_query(spark.read.parquet(f"{sf_small}/documents.parquet"))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want and sum(r[2] for r in want) > 0
