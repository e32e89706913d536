import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from kinfold.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_fills(counts, fills, capacity):
    used = Counter()
    for lengths, times in fills:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter({k: v for k, v in counts.items() if v})


def best_bins(items, capacity):
    """Fewest bins, by trying every bin for every item."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_search_is_as_good_as_trying_all():
    rnd = random.Random(1)
    for _ in range(60):
        items = sorted((rnd.randrange(1, 31) for _ in range(rnd.randrange(1, 13))), reverse=True)
        s = packing.Search(30)
        fills = s.run(Counter(items))
        check_fills(Counter(items), fills, 30)
        assert s.bound == best_bins(items, 30) == s.bins
        assert s.bins == sum(n for _, n in fills)


def all_fillings(items, room):
    out = {()}
    for x in items:
        out |= {tuple(sorted((*f, x), reverse=True)) for f in out if sum(f) + x <= room}
    return out


def test_fillings_are_the_undominated_ones():
    """Every filling to which no piece can be added and of which no one or two pieces can give way to a longer one."""
    rnd = random.Random(2)
    for _ in range(60):
        items = [rnd.randrange(1, 16) for _ in range(rnd.randrange(0, 9))]
        room, spare = rnd.randrange(0, 25), rnd.randrange(0, 25)
        have = np.bincount(items, minlength=31)
        got = list(packing.fillings(have, room, spare))
        assert len(got) == len(set(got)) and got == sorted(got, key=lambda f: packing._order(f, room))

        def undominated(f):
            gap, left = room - sum(f), list((Counter(items) - Counter(f)).elements())
            parts = [0, *f, *(a + b for i, a in enumerate(f) for b in f[i + 1 :])]
            return not any(p + (p == 0 or p in f) <= y <= p + gap and gap for p in parts for y in left)

        assert set(got) == {f for f in all_fillings(items, room) if room - sum(f) <= spare and undominated(f)}


def test_triples_that_fill_bins_exactly():
    rnd = random.Random(7)
    for n, low in ((20, 300), (20, 1), (200, 1)):
        items = []
        while len(items) < 3 * n:
            a, b = rnd.randrange(low, 1000), rnd.randrange(low, 1000)
            items += [a, b, 2048 - a - b]
        s = packing.Search(2048)
        fills = s.run(Counter(items))
        check_fills(Counter(items), fills, 2048)
        assert s.bins - s.bound <= 1 and s.bound == n
        assert n > 20 or s.bins == n


def best_fit_decreasing(sizes, capacity):
    gaps = Counter()
    bins = 0
    for x in sorted(sizes, reverse=True):
        g = next((g for g in range(x, capacity) if gaps[g]), None)
        if g is None:
            bins, g = bins + 1, capacity
        else:
            gaps[g] -= 1
        gaps[g - x] += 1
    return bins


def test_search_with_large_counts():
    for mean, n in ((6, 40_000), (5.5, 3_000), (7, 3_000)):
        sizes = np.minimum(np.random.default_rng(2).lognormal(mean, 1, n).astype(int) + 1, 2048)
        counts = Counter(sizes.tolist())
        s = packing.Search(2048)
        fills = s.run(counts)
        check_fills(counts, fills, 2048)
        assert s.bins <= best_fit_decreasing(sizes.tolist(), 2048)
        assert s.bins <= 1.002 * s.bound + 1
        assert fills == packing.Search(2048).run(counts)


def test_query_equals_the_tokenizer(spark):
    rnd = random.Random(3)
    words = ["Hello,", "it's", "naïve", "Ünï", "123", "日本語", "éa", "x y", "a b", "don't!!", "#$%", "\U0001f600", "İ", "ΑΣ"]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (None, "b c"), (5, "<|endoftext|> x")]
    rows += [(10 + i, rnd.choice(["", " "]).join(rnd.choice(words) + rnd.choice([" ", "\n", "\t", "  "]) for _ in range(rnd.choice([1, 5, 100, 3000])))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as rank", "3 as salt")
    got = packing.op3_query(df).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((k, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert {(r.sequences, r.at_least) for r in got} == {(len(bins), len(bins))}
    assert len(bins) == packing.lower_bound(np.bincount([r.length for r in got], minlength=2049), 2048)
    assert packing.op3_query(df.limit(0)).count() == 0


def test_ranks_are_dealt_by_salt(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTED_ROWS", 50)
    df = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 700, 1 + id % 40) as long) as length")
    got = packing.place(df).collect()
    assert len(got) == len({(r.sequence_id, r.offset) for r in got}) == 1000
    assert len({r.sequence_id for r in got}) == packing.lower_bound(np.bincount([r.length for r in got], minlength=2049), 2048)


def test_ids_come_out(spark):
    r = packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH, with_ids=True).collect()
    assert list(r[0].ids) == Tokenizer.from_file(PATH).encode("a b", add_special_tokens=False).ids + [0]


def test_words_give_the_ids_of_the_text(monkeypatch):
    rnd = random.Random(4)
    tok = Tokenizer.from_file(PATH)
    words = packing.WordTokenizer(PATH)
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    letters = "abcdefgzÄöñéßİıΣσς日本कि'’“.,!?;:-#1２½Ⅷªº̈\U0001f600"
    for _ in range(40):
        texts = ["".join(rnd.choice(letters) * rnd.choice([1, 1, 1, 3]) + rnd.choice(["", "", "", " ", "\n", "  "]) for _ in range(rnd.randrange(120))) for _ in range(5)]
        texts += ["Hello, World. Hello, it's; don't!! e.g.", "x" * 200 + ". y", "<|startoftext|>a <|ENDOFTEXT|>B"]
        got = list(words.ids(pa.array([*texts, None])))
        assert got.pop() == b""
        assert got == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
