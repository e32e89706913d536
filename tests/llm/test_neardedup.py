import random

import numpy as np

from kinfold.llm import neardedup
from kinfold.llm.simhash import Nearest, group_links, gray_rank, shingle_hashes


def jaccard(a, b):
    x, y = (set(shingle_hashes(t.encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_group_stays(spark):
    rnd = random.Random(6)
    words = ["w%d" % i for i in range(900)]
    rows, group = [], {}
    for g in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 150, 600]))]
        for c in range(rnd.choice([1, 2, 3, 8])):
            t = list(base)
            if c:
                for _ in range(max(1, len(t) // 60)):
                    t[rnd.randrange(len(t))] = "edit%d" % rnd.randrange(99)
            rows.append((1000 * g + c, " ".join(t).upper() if c == 2 else "  ".join(t)))
            group[1000 * g + c] = g
    odd = [(-1, None), (-2, ""), (-3, " \n"), (-4, "one two"), (-5, "ONE  two"), (None, "one two"), (-6, "one two three"), (-7, "x " * 30_000), (-7, "x " * 30_000), (None, "alone here")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 as id", "2 as words", "3 as a")
    got = neardedup.near_dedup(df)
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(k for k in kept if k is not None and k < 0) == [-7, -6, -5, -3] and kept.count(None) == 1
    mine = [k for k in kept if k is not None and k >= 0]
    text, missed = dict(rows), 0
    for g in range(40):
        own, all_ = [k for k in mine if group[k] == g], [k for k in group if group[k] == g]
        assert min(own) == min(all_)
        missed += sum(jaccard(text[a], text[b]) >= 0.8 for a in own for b in own if a < b)
    assert missed <= 2
    assert neardedup.near_dedup(df.limit(0)).count() == 0


def test_recall_against_brute_force(spark):
    """Pairs of 0.8 and more in the table against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in neardedup.near_dedup(docs).collect()}
    sets = {k: set(shingle_hashes(t.encode(), 5)) for k, t in text.items()}
    by = {}
    for k, s in sets.items():
        for h in s:
            by.setdefault(h, []).append(k)
    near = {(a, b) for m in by.values() for a in m for b in m if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near) > 60
    assert sum(a in kept and b in kept for a, b in near) <= 0.05 * len(near)
    dropped = set(text) - kept
    assert all(any(d in p for p in near) for d in dropped)


def test_link_recall_with_entries_split(spark, monkeypatch):
    """Pairs of 0.8 and more that come into one group, with entries whole and with all over 20 documents split."""
    from functools import partial

    from kinfold.operators.components import connected_components

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(neardedup.F.col("doc_id").alias("_near_id"), "doc_id", "text")
    sets = {r.doc_id: set(shingle_hashes((r.text or "").encode(), 5)) for r in docs.collect()}
    by = {}
    for k, s in sets.items():
        for h in s:
            by.setdefault(h, []).append(k)
    near = {(a, b) for m in by.values() for a in m for b in m if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    made = neardedup.materialize(neardedup.sketches(docs, "doc_id", "text").where("length(words) > 0"))
    candidate, further = neardedup.candidate_pairs, neardedup.further_pairs
    for most in (20_000, 20):
        monkeypatch.setattr(neardedup, "candidate_pairs", partial(candidate, most=most))
        monkeypatch.setattr(neardedup, "further_pairs", partial(further, most=most))
        links = neardedup.near_links(made.select("id", "sketch"), docs, "text", 0.8)
        group = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
        found = sum(group.get(a, a) == group.get(b, b) for a, b in near)
        assert found >= 0.95 * len(near), (most, found, len(near))
        assert all((min(r.a, r.b), max(r.a, r.b)) in near for r in links.collect())


def test_nearest():
    r = np.random.default_rng(1)
    f = r.integers(0, 2**63, (300, 1), dtype=np.int64).view(np.uint64)
    f[100:] = f[:200] ^ np.uint64(5)
    i, j = group_links(np.zeros(300, np.int64), gray_rank(f[:, 0]), f, 20, Nearest)
    d = np.bitwise_count(f ^ f.T).astype(int)
    np.fill_diagonal(d, 99)
    assert (d[i, j] == d[i].min(axis=1)).all()
    assert set(i) == set(np.flatnonzero(d.min(axis=1) <= 20))


def test_large_entries_are_dealt_by_further_bits(spark, monkeypatch):
    """A family of near copies that fills table entries still meets itself."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        t = list(base)
        for _ in range(3):
            t[rnd.randrange(300)] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(f"x{rnd.randrange(5000)}" for _ in range(200))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    f = neardedup.candidate_pairs
    for most in (20_000, 40):
        monkeypatch.setattr(neardedup, "candidate_pairs", lambda nodes, n, most=most: f(nodes, n, most))
        kept = sorted(r.doc_id for r in neardedup.near_dedup(df).collect())
        assert kept[0] == 0 and [k for k in kept if k >= 1000] == list(range(1000, 1050))
        assert len(kept) <= 50 + 1 + 6


def edited(t, at, mark):
    return [f"{mark}{i}" if i in at else w for i, w in enumerate(t)]


def with_sketches(monkeypatch, sketch):
    """near_dedup's sketches, but those given by key as the places of their set bits."""

    def sketches(docs, key, text):
        rows = [(k, sum(1 << b for b in bits).to_bytes(8 * neardedup.WORDS, "little")) for k, bits in sketch.items()]
        given = docs.sparkSession.createDataFrame(rows, f"{key} long, sketch binary")
        return docs.join(given, key).selectExpr("_near_id as id", f"{key} as key", f"cast({text} as binary) as words", "sketch")

    monkeypatch.setattr(neardedup, "sketches", sketches)


def test_a_pair_is_found_beside_nearer_ones(spark, monkeypatch):
    """Two tight clusters linked by one pair of 0.8: in every entry each member has a twin that is nearer."""
    base = [f"w{i}" for i in range(300)]
    other = edited(base, range(5, 65, 10), "b")
    rows, sketch = [(1, base), (101, other)], {1: [], 101: [*range(100, 140)]}
    for i in range(6):
        rows += [(2 + i, edited(base, range(100 + i, 130, 10), f"a{i}")), (102 + i, edited(other, range(200 + i, 230, 10), f"b{i}"))]
        sketch |= {2 + i: [i], 102 + i: [*range(100, 140), 200 + i]}
    rows = [(k, " ".join(t)) for k, t in rows]
    text = dict(rows)
    assert [(x, y) for x in text for y in text if x < 100 < y and jaccard(text[x], text[y]) >= 0.8] == [(1, 101)]
    with_sketches(monkeypatch, sketch)
    assert [r.doc_id for r in neardedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]


def test_nearby_keeps_the_nearest_of_other_components(monkeypatch):
    monkeypatch.setattr(neardedup, "HELD", 1000)
    r = np.random.default_rng(2)
    f = r.integers(0, 2**12, (200, 1)).astype(np.uint64)
    f = f[np.argsort(gray_rank(f[:, 0]), kind="stable")]
    component = r.integers(0, 20, 200)
    d = np.bitwise_count(f ^ f.T).astype(int)
    d[component[:, None] == component] = 99
    for most in (1, 3, 500):
        found = neardedup.Nearby(component, most)
        group_links(np.zeros(200, np.int64), gray_rank(f[:, 0]), f, 5, lambda n, found=found: found)
        row, distance, partner = found.cut()
        assert (found.partners == (d <= 5).sum(axis=1)).all()
        assert (d[row, partner] == distance).all()
        for i in range(200):
            assert sorted(distance[row == i]) == sorted(x for x in d[i] if x <= 5)[:most]


def test_a_large_entry_loses_no_pair(spark, monkeypatch):
    """A pair whose entries are all large and whose sub-entries are never the same."""
    bits, rnd = neardedup.table_bits(), random.Random(3)
    while True:
        far = set(rnd.sample(range(256), 40))
        same = [far.isdisjoint(b[: neardedup.BITS].tolist()) for b in bits]
        if any(same) and not any(far.isdisjoint(b.tolist()) for b in bits):
            break
    base = [f"w{i}" for i in range(300)]
    rows = [(1, base), (2, edited(base, range(5, 65, 10), "b"))] + [(10 + i, [f"x{i}y{j}" for j in range(100)]) for i in range(60)]
    sketch = {1: [], 2: [*far]} | {10 + i: [b for b in range(256) if b == i] for i in range(60)}
    with_sketches(monkeypatch, sketch)
    f = neardedup.candidate_pairs
    monkeypatch.setattr(neardedup, "candidate_pairs", lambda nodes, n: f(nodes, n, 20))
    kept = sorted(r.doc_id for r in neardedup.near_dedup(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")).collect())
    assert kept == [1, *range(10, 70)]


def test_blocks_of_a_large_entry_meet(spark):
    r = np.random.default_rng(5)
    sketch = [int.to_bytes(sum(1 << int(b) for b in r.choice(256, 6, replace=False)), 32, "little") for _ in range(120)]
    rows = [(i, sketch[i], 0 if i < 70 else i // 2) for i in range(120)]
    nodes = spark.createDataFrame(rows, "id long, sketch binary, component long")
    whole, split = ({tuple(x) for x in neardedup.further_pairs(nodes, 120, 500, most).collect()} for most in (1000, 8))
    assert whole == split and len(whole) > 1000


def test_a_family_makes_no_row_for_each_pair(spark, monkeypatch):
    """Copies of one text that are not alike enough to hang together, but for two: every two are compared, no two are listed."""
    rnd, base = random.Random(4), [f"w{i}" for i in range(200)]
    rows = [(i, edited(base, rnd.sample(range(200), 12), f"e{i}x")) for i in range(150)]
    rows.append((500, edited(rows[70][1], [3, 90], "z")))
    text = {k: " ".join(t) for k, t in rows}
    near = [(x, y) for x in text for y in text if x < y and jaccard(text[x], text[y]) >= 0.8]
    assert (70, 500) in near and len(near) < 10
    with_sketches(monkeypatch, {k: [k % 256] for k in text})
    made, keep = {}, neardedup.materialize

    def seen(df, name="step", *a):
        out = keep(df, name, *a)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(neardedup, "materialize", seen)
    kept = {r.doc_id for r in neardedup.near_dedup(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    part = {k: k for k in text}
    for _ in near:
        for x, y in near:
            part[x] = part[y] = min(part[x], part[y])
    assert kept == set(part.values())
    assert max(made.values()) <= 36 * len(text)


def test_blocks_of_a_family_unite_as_the_whole(spark, monkeypatch):
    rnd, base = random.Random(6), [*range(100)]
    kept = [rnd.choice([0.98, 0.9, 0.7]) for _ in range(90)]
    sets = {i: sorted({x if rnd.random() < kept[i] else rnd.randrange(10**6) for x in base}) for i in range(90)}
    rows = [(i // 60, i, bytes(32), i if i % 3 else 0, s) for i, s in sets.items()]
    members = spark.createDataFrame(rows, "family long, id long, sketch binary, component long, shingles array<long>")
    like = lambda x, y: len({*sets[x]} & {*sets[y]}) >= 0.8 * len({*sets[x]} | {*sets[y]})
    edges = [(x, y) for x in sets for y in sets if x < y and x // 60 == y // 60 and like(x, y)]

    def parts(links):
        part = {(i // 60, i): (i // 60, i if i % 3 else 0) for i in sets}
        for _ in range(20):
            for x, y in links:
                p, q = part[x // 60, x], part[y // 60, y]
                part = {k: min(p, q) if v in (p, q) else v for k, v in part.items()}
        return part

    for least in (1000, 7):
        monkeypatch.setattr(neardedup, "LEAST_BLOCK", least)
        monkeypatch.setattr(neardedup, "MOST_BLOCK", least)
        found = [tuple(r) for r in neardedup.united(members, 0.8).collect()]
        assert {*found} <= {*edges} and parts(found) == parts(edges)
        assert len({*parts(found).values()}) < len({(i // 60, i if i % 3 else 0) for i in sets})


def test_contracted_links_unite_the_same(spark, monkeypatch):
    from kinfold.operators.components import connected_components

    rnd = random.Random(8)
    rows = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(2000)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(25)]
    links = neardedup.materialize(spark.createDataFrame(rows, "a long, b long").repartition(4))
    parts = lambda e: {tuple(r) for r in connected_components(e, "a", "b").collect()}
    for most in (10**6, 700):
        monkeypatch.setattr(neardedup, "LINKS", most)
        assert parts(neardedup.contracted(links)) == parts(links)
        assert neardedup.contracted(links).count() <= 100 * -(-len(rows) // most)
    assert neardedup.contracted(links.where("a < 0")).isEmpty()
