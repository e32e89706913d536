"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A document is cut into blocks at content-defined places: each run of windows (``window`` consecutive words) that share
their lowest-hashed ``gram`` words, the block's anchor, forms one block, which reaches from the first word of the first
of these windows to the last word of the last. Equal stretches of text cut alike whatever surrounds them, so a document
is factored greedily into blocks that are looked up whole in the index of all blocks of all documents; the index keeps
the lowest document of each block, the reference that a factor points to. A block that a lower document has too is one
factor, and each of its windows starts there.

Where a factor ends, a window may still run over from a block that is known into one that is not, and be known itself.
So blocks that are new but whose anchor other blocks have too (an edit nearby, a cut text) are opened: the lowest
document of each such block lists its windows, and their lowest documents decide one by one. Windows of equal words
have equal anchors, so nothing outside these blocks can match.

Blocks come about every (window - gram) / 2 words, and only blocks at factor boundaries are opened, so what is shuffled
is a small part of the windows, however often a passage repeats. Windows are told apart by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import U64, batch, mix, texts
from kinfold.runtime import materialize

GRAM = 12
#: Odd multipliers of the two polynomial hashes and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.empty(n, U64)
    p[0] = 1
    p[1:] = U64(base)
    return np.multiply.accumulate(p)


class Hasher:
    """Hashes of word ranges from prefix sums of a polynomial over word hashes, modulo 2^64."""

    def __init__(self) -> None:
        self.n = 0
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            self.up = [_powers(b, self.n) for b in BASES]
            self.down = [_powers(b, self.n) for b in INVERSES]

    def prefixes(self, words: np.ndarray) -> list[np.ndarray]:
        self._grow(len(words) + 1)
        return [np.concatenate([np.zeros(1, U64), np.cumsum(words * p[: len(words)], dtype=U64)]) for p in self.up]

    def ranges(self, prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return mix((prefix[which][end] - prefix[which][start]) * self.down[which][start] + (end - start).astype(U64))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


class Blocks:
    """The blocks of one text: ``start`` and ``stop`` number its windows, ``anchor`` and ``body`` are hashes."""

    def __init__(self, words: list[bytes], window: int, gram: int, hasher: Hasher):
        n = len(words)
        self.hasher, self.window = hasher, window
        self.windows = n - window + 1
        if self.windows < 1:
            self.start = self.stop = np.zeros(0, np.int64)
            self.anchor = self.body = np.zeros(0, U64)
            return
        w = np.fromiter(map(xxhash.xxh64_intdigest, words), U64, n)
        self.prefix = hasher.prefixes(w)
        at = np.arange(n - gram + 1)
        grams = hasher.ranges(self.prefix, at, at + gram, 0)
        low = sliding_min(grams, window - gram + 1)
        self.start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        self.stop = np.r_[self.start[1:], self.windows]
        self.anchor = low[self.start]
        self.body = hasher.ranges(self.prefix, self.start, self.stop + window - 1, 1)

    def window_ids(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and two hashes of each window of the given blocks."""
        size = self.stop[blocks] - self.start[blocks]
        at = np.repeat(self.start[blocks], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return at, self.hasher.ranges(self.prefix, at, at + self.window, 0), self.hasher.ranges(self.prefix, at, at + self.window, 1)


def _among(a: np.ndarray, b: np.ndarray, these: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) occur in ``these``, a (k, 2) array."""
    if not len(these):
        return np.zeros(len(a), bool)
    both = np.empty(len(a) + len(these), [("a", U64), ("b", U64)])
    both["a"], both["b"] = np.r_[a, these[:, 0]], np.r_[b, these[:, 1]]
    return np.isin(both[: len(a)], both[len(a) :])


def _pairs(column: pa.Array) -> list[np.ndarray]:
    """An array<struct<long, long>> column as (k, 2) uint64 arrays; null as none."""
    flat, off = column.flatten(), np.asarray(column.value_lengths().fill_null(0))
    a, b = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for i in (0, 1))
    ends = np.cumsum(off)
    return [np.stack([a[e - n : e], b[e - n : e]], axis=1) for e, n in zip(ends.tolist(), off.tolist(), strict=True)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def duplicate_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM) -> DataFrame:
    """``(key, text, n_words, spans, kept_text)`` per document.

    A word is a run of bytes other than ASCII white space. ``spans`` holds (first word, words) of the stretches covered
    by windows of ``window`` words that also start in a document with a smaller key; ``kept_text`` has the other words,
    joined by one space. Windows are judged on the input. Documents with equal keys are no reference to each other; a
    null key neither refers nor is referred to; null and short texts have no window. All rows come back, repeated ones
    as often as given; other columns of ``docs`` are not read.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in it:
            keys, anchors, bodies = [], [], []
            for i, t in enumerate(texts(b.column(1))):
                x = Blocks(t.split(), window, gram, hasher)
                if len(x.start):
                    keys.append(np.full(len(x.start), i))
                    anchors.append(x.anchor)
                    bodies.append(x.body)
            if keys:
                yield batch(key=b.column(0).take(pa.array(np.concatenate(keys))), anchor=_signed(np.concatenate(anchors)), body=_signed(np.concatenate(bodies)))

    blocks = materialize(docs.where("key is not null").mapInArrow(cut, f"key {kind}, anchor long, body long"), "blocks")
    index = blocks.groupBy("anchor", "body").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = index.groupBy("anchor").agg(F.count("*").alias("forms"), F.min("low").alias("a"), F.max("high").alias("z")).where("a < z").select("anchor", "forms")
    index = materialize(index.join(shared, "anchor").where("forms > 1 or low < high"), "index")
    found = blocks.join(index, ["anchor", "body"]).where("low < key or forms > 1")
    pair = F.struct("anchor", "body")
    lists = materialize(found.groupBy("key").agg(F.collect_set(F.when(F.col("low") < F.col("key"), pair)).alias("known"), F.collect_set(F.when(F.col("low") == F.col("key"), pair)).alias("opened")), "lists")

    def open_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in it:
            keys, h1, h2 = [], [], []
            for i, (t, opened) in enumerate(zip(texts(b.column(1)), _pairs(b.column(2)), strict=True)):
                x = Blocks(t.split(), window, gram, hasher)
                if len(x.start):
                    _, a, c = x.window_ids(np.flatnonzero(_among(x.anchor, x.body, opened)))
                    keys.append(np.full(len(a), i))
                    h1.append(a)
                    h2.append(c)
            if keys:
                yield batch(key=b.column(0).take(pa.array(np.concatenate(keys))), h1=_signed(np.concatenate(h1)), h2=_signed(np.concatenate(h2)))

    at_boundary = docs.join(lists.where(F.size("opened") > 0).select("key", "opened"), "key")
    windows = materialize(at_boundary.select("key", "text", "opened").mapInArrow(open_blocks, f"key {kind}, h1 long, h2 long"), "windows")
    lowest = windows.groupBy("h1", "h2").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").drop("high")
    lowest = materialize(lowest, "lowest")  # so that the join below has exchanges of its own and a hot window can be split
    seen = windows.join(lowest, ["h1", "h2"]).where("low < key").groupBy("key").agg(F.collect_set(F.struct("h1", "h2")).alias("seen"))
    known = lists.where(F.size("known") > 0).select("key", "known")
    marks = known.join(seen, "key", "full").join(lists.where(F.size("opened") > 0).select("key", "opened"), "key", "left")

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in it:
            counts, spans, kept = [], [], []
            for t, sure, opened, single in zip(texts(b.column(1)), *(_pairs(b.column(i)) for i in (2, 3, 4)), strict=True):
                words = t.split()
                counts.append(len(words))
                runs: list[tuple[int, int]] = []
                if len(sure) or len(single):
                    x = Blocks(words, window, gram, hasher)
                    hit = np.zeros(max(x.windows, 0) + 1, bool)
                    whole = np.flatnonzero(_among(x.anchor, x.body, sure))
                    at, _, _ = x.window_ids(whole)
                    hit[at] = True
                    at, h1, h2 = x.window_ids(np.flatnonzero(_among(x.anchor, x.body, opened)))
                    hit[at[_among(h1, h2, single)]] = True
                    first = np.flatnonzero(hit)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + window, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    runs = [(int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2], strict=True)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                spans.append([{"start": s, "words": n} for s, n in runs])
                kept.append(b" ".join(words))
            yield batch(
                key=b.column(0), text=b.column(1), n_words=pa.array(counts, pa.int64()),
                spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))), kept_text=pa.array(kept, pa.binary()).cast(pa.string()),
            )

    joined = docs.join(marks, "key", "left").select("key", "text", "known", "opened", "seen")
    return joined.mapInArrow(mark, f"key {kind}, text string, n_words long, spans array<struct<start:long,words:long>>, kept_text string").withColumnRenamed("key", key)


def op6_query(docs: DataFrame) -> DataFrame:
    found = duplicate_spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM t),
s AS (SELECT r, doc_id, pos, word, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h, pos + 49 <= n AS whole FROM p),
f AS (SELECT h, min(doc_id) AS low FROM s WHERE whole GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT s.r, s.pos, s.word, coalesce(max(CASE WHEN s.whole AND f.low < s.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY s.r ORDER BY s.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM s LEFT JOIN f ON s.h = f.h),
k AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (r)
"""
