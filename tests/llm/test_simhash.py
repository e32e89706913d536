import random

import numpy as np
import xxhash

from kinfold.llm import simhash
from kinfold.llm.common import U64, majority


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted((str(k), low.get(find(i))) for i, (k, _) in enumerate(rows))


def test_majority_counts_over_255_members():
    r = np.random.default_rng(1)
    lens = np.array([0, 1, 700, 255, 256, 0, 3])
    h = r.integers(0, 2**63, lens.sum(), dtype=np.int64).view(U64) * U64(2)
    got, at = majority(h, lens), 0
    for n, g in zip(lens, got):
        seg = [int(x) for x in h[at : at + n]]
        at += n
        assert int(g) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in seg) > n)


def test_query_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "delta", "éa", "x y", "zeta"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "ONE Two"), (7, "one  two"), (7, "one two"), (None, "a b c d"), (8, "A B\nC d")]
    base = " ".join(rnd.choice(words) for _ in range(400))
    for i in range(60):
        t = base.split(" ")
        for _ in range(i % 5):
            t[rnd.randrange(400)] = rnd.choice(words)
        rows.append((100 + i, " ".join(t)))
    rows += [(300 + i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as key", "3 as component")
    got = simhash.op7_query(df).collect()
    fp = {k: brute_fingerprint(t) for k, t in rows if k != 7}
    for r in got:
        if r.doc_id not in (None, 7):
            assert r.fingerprint == f"{fp[r.doc_id]:016x}"
    want = brute_components([(k, brute_fingerprint(t)) for k, t in rows])
    assert sorted((str(r.doc_id), r.component_id) for r in got) == want
    assert simhash.op7_query(df.limit(0)).count() == 0


def test_components_with_split_groups(spark):
    """A family of near fingerprints over the size of a task's group, and random ones, against brute force."""
    rnd = random.Random(7)
    base = rnd.getrandbits(64)
    fps = set()
    while len(fps) < 900:
        x = base
        for _ in range(rnd.randrange(9)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    while len(fps) < 1500:
        fps.add(rnd.getrandbits(64))
    rows = [(i, x) for i, x in enumerate(rnd.sample(sorted(fps), len(fps)))]
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in rows], "doc_id long, fp long")
    want = brute_components(rows)
    for max_group in (10**6, 40):
        got = simhash.simhash_components(df, "doc_id", 2, max_group=max_group).collect()
        assert sorted((str(r.doc_id), r.component) for r in got) == want


def test_tree_equals_comparing_all():
    r = np.random.default_rng(3)
    f = (r.integers(0, 2**62, (3, 1), dtype=np.int64).repeat(400, 0) ^ (1 << r.integers(0, 62, (1200, 1))) ^ (1 << r.integers(0, 62, (1200, 1)))).view(U64)
    i, j = simhash.group_links(np.zeros(len(f), np.int64), simhash.gray_rank(f[:, 0]), f, 2)
    links, all_ = simhash.Links(len(f)), simhash.Links(len(f))
    links.join(i, j)
    a, b = np.nonzero(np.bitwise_count(f ^ f.T) <= 2)
    all_.join(a, b)
    assert len(set(links.label)) == len(set(all_.label))
    assert all(len(set(links.label[all_.label == x])) == 1 for x in set(all_.label))
