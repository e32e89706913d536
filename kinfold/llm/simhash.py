"""SimHash near-duplicates through a Gray-order hierarchical index.

``fingerprints`` computes SimHash words, ``hamming_links`` finds what lies within a radius of what, and
``near_duplicates`` / ``op7`` put the components together.

The index. Two 64-bit fingerprints within r bits agree wholly on at least one of r + 1 fixed bit fields, so each
fingerprint is filed once under each field. Below a field value stands one tree: its members sorted by Gray rank, in
blocks of ``LEAF`` whose common bits are factored into a masked pattern, four blocks under an upper node with the bits
that all four share, and so on. A pair of nodes whose patterns differ in more than r of the bits that both fix is left
with all that stands below it; the rest is opened level by level down to an exact comparison. A tree of one leaf is that
comparison. A field value with over ``max_group`` members (a large family of near copies) is dealt to several tasks by its
next Gray-ordered bits, and a member visits the blocks of the same value that have members of their own and whose bits
differ from its own in at most r places; a block with too many members of its own is dealt by the bits after these, and so
on down to the last bits.

What leaves a task are not all pairs but, for each member, a link to the smallest member it hangs together with there:
components come out whole and the output grows with the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import MASK64, U64, batch, majority, mix, texts
from kinfold.operators.components import connected_components
from kinfold.runtime import materialize, partitions_for, small

SEED = 42
LEAF, FAN = 32, 4
SMALL = LEAF
CHUNK = 4096
#: Members of a bit-field value that one task compares; beyond it the value is split.
MAX_GROUP = 20_000
#: Further bits that split a large value or block.
SPLIT_BITS = 12


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of each k-word shingle of a lower-cased text, repeats included; the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(first, ends[k - 1 :].tolist(), strict=True)]


def fingerprint_words(batch_texts: list[bytes], k: int, words: int = 1) -> np.ndarray:
    """SimHash of each text as ``words`` uint64: the first from the shingle hashes, the others from remixed ones."""
    out = np.zeros((len(batch_texts), words), U64)
    done = 0
    while done < len(batch_texts):
        hashes, lens, size = [], [], 0
        for t in batch_texts[done:]:
            h = shingle_hashes(t, k)
            hashes.append(np.array(h, U64))
            lens.append(len(h))
            size += len(h)
            if size > 1_000_000:
                break
        h, n = np.concatenate(hashes), np.array(lens, np.int64)
        for w in range(words):
            out[done : done + len(n), w] = majority(h if not w else mix(h + U64((w * 0x9E3779B97F4A7C15) & MASK64)), n)
        done += len(n)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, words: int = 1) -> DataFrame:
    """``(key, fp, sketch)``: the first SimHash word as a signed long, all words as little-endian binary.

    A null, empty or blank text has the fingerprint zero. Other columns of ``docs`` are not read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            f = fingerprint_words(texts(b.column(1)), k, words)
            yield batch(key=b.column(0), fp=pa.array(f[:, 0].view(np.int64)), sketch=pa.array([r.tobytes() for r in f], pa.binary()))

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long, sketch binary")
    return out.withColumnRenamed("key", key)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each uint64 in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(s))
    return x


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Links:
    """Union-find over row numbers, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray | None = None) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


class Nearest:
    """For each row the nearest row that it was paired with, the smaller row number on ties; -1 without a pair."""

    def __init__(self, n: int):
        self.best = np.full(n, np.iinfo(np.int64).max)

    def join(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        np.minimum.at(self.best, i, distance << 40 | j)
        np.minimum.at(self.best, j, distance << 40 | i)

    @property
    def label(self) -> np.ndarray:
        return np.where(self.best == np.iinfo(np.int64).max, np.arange(len(self.best)), self.best & ((1 << 40) - 1))


def _tree(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of the index over Gray-sorted rows, leaves first: (first row, mask of the shared bits, pattern)."""
    at = np.arange(0, len(f), LEAF)
    both, none = (np.bitwise_and.reduceat(x, at, axis=0) for x in (f, ~f))
    levels = []
    while True:
        levels.append((at, both | none, both))
        if len(at) == 1:
            return levels
        up = np.arange(0, len(both), FAN)
        both, none, at = np.bitwise_and.reduceat(both, up, axis=0), np.bitwise_and.reduceat(none, up, axis=0), at[up]


def _large(f: np.ndarray, radius: int, base: int, links: Links | Nearest) -> None:
    """All pairs of rows of ``f`` (Gray-sorted) within the radius, joined in ``links`` under rows from ``base``."""
    levels = _tree(f)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    offsets = np.arange(LEAF)
    while todo:
        level, a, b = todo.pop()
        if len(a) > CHUNK:
            todo += [(level, a[CHUNK:], b[CHUNK:])]
            a, b = a[:CHUNK], b[:CHUNK]
        _, mask, pattern = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]).sum(axis=-1, dtype=np.int64) <= radius
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level:
            below = len(levels[level - 1][0])
            x = (a[:, None] * FAN + np.arange(FAN)).repeat(FAN, axis=1).ravel()
            y = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
            ok = (x <= y) & (y < below)
            todo.append((level - 1, x[ok], y[ok]))
            continue
        for s in range(0, len(a), 256):
            i = (a[s : s + 256, None] * LEAF + offsets).repeat(LEAF, axis=1).ravel()
            j = np.tile(b[s : s + 256, None] * LEAF + offsets, (1, LEAF)).ravel()
            ok = (i < j) & (j < len(f))
            i, j = i[ok], j[ok]
            d = _differ(f[i], f[j])
            ok = d <= radius
            links.join(i[ok] + base, j[ok] + base, d[ok])


def group_links(group: np.ndarray, order: np.ndarray, f: np.ndarray, radius: int, kind: type[Links] | type[Nearest] = Links) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hang together within a group by steps of ``radius`` bits or fewer: (row, smallest such row), or, with
    ``kind`` Nearest, each row and the nearest to it within ``radius`` bits.

    ``group`` numbers the groups, ``order`` is the Gray rank that sorts inside a group, ``f`` holds (rows, words).
    Rows that have no other are left out. Small groups are compared whole, large ones through the tree.
    """
    by = np.lexsort((order, group))
    g, f = group[by], f[by]
    links = kind(len(g))
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])
    size = np.repeat(sizes, sizes)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    for d in range(1, SMALL):
        i = small[small + d < len(g)]
        i = i[g[i] == g[i + d]]
        if not len(i):
            break
        small = i
        for s in range(0, len(i), 1 << 18):
            x = i[s : s + (1 << 18)]
            apart = _differ(f[x], f[x + d])
            ok = apart <= radius
            links.join(x[ok], x[ok] + d, apart[ok])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        _large(f[s : s + n], radius, s, links)
    label = links.label
    moved = np.flatnonzero(label != np.arange(len(g)))
    return by[moved], by[label[moved]]


def hamming_links(fps: DataFrame, radius: int, rows: int, max_group: int = MAX_GROUP, split_bits: int = SPLIT_BITS) -> DataFrame:
    """Links among the distinct non-null longs ``fps(fp)``: ``(src, dst)`` such that what lies within ``radius`` bits
    is connected. ``rows`` is their number; it sizes the partitions and decides nothing else."""
    spark = fps.sparkSession
    fields = radius + 1
    cuts = [64 * i // fields for i in range(fields + 1)]
    # A field is rotated to the top: its bits come first in Gray order, the bits after it next.
    turned = F.array(*[F.col("fp") if not c else F.shiftleft("fp", c).bitwiseOR(F.shiftrightunsigned("fp", 64 - c)) for c in cuts[:-1]])
    filed = fps.select("fp", F.posexplode(turned).alias("field", "turned"))
    width = F.element_at(F.array(*[F.lit(b - a) for a, b in zip(cuts, cuts[1:], strict=False)]), F.col("field") + 1)
    value = F.call_function("shiftrightunsigned", F.col("turned"), F.lit(64) - width)
    # Groups go by a hash of what their members agree on: should two coincide, they are compared together.
    filed = filed.select(F.xxhash64("field", value).alias("path"), "turned", "fp", width.alias("used"), F.lit(True).alias("own"))
    flips = [0, *(1 << i for i in range(split_bits))] if radius else [0]
    near = [0]
    for _ in range(min(radius, split_bits)):
        near = sorted({x ^ y for x in near for y in flips})
    block = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("turned"), F.col("used")), F.lit(64 - split_bits))
    visits = F.filter(F.transform(F.array(*[F.lit(x).cast("long") for x in near]), lambda m: m.bitwiseXOR(F.col("block"))), lambda x: x >= F.col("block"))
    whole = None
    while not (large := materialize(filed.where("own").groupBy("path").count().where(F.col("count") > max_group).select("path", F.lit(True).alias("large")), "large")).isEmpty():
        marked = filed.join(small(large), "path", "left").withColumn("large", F.coalesce(F.col("large") & (F.col("used") + split_bits <= 64), F.lit(False)))
        rest = marked.where("not large").drop("large")
        whole = rest if whole is None else whole.unionAll(rest)
        dealt = marked.where("large").withColumn("block", block).withColumn("visited", F.explode(visits))
        dealt = dealt.select(F.xxhash64("path", "visited").alias("path"), "turned", "fp", (F.col("used") + split_bits).alias("used"), (F.col("own") & (F.col("block") == F.col("visited"))).alias("own"))
        dealt = materialize(dealt, "dealt")
        filed = materialize(dealt.join(dealt.where("own").select("path").distinct(), "path", "left_semi"), "visits")
    filed = (filed if whole is None else whole.unionAll(filed)).select("path", "turned", "fp")
    n = partitions_for(spark, rows * fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = [x for x in it if x.num_rows]
        if not b:
            return
        path, rotated, fp = (np.concatenate([x.column(i).to_numpy() for x in b]) for i in range(3))
        i, j = group_links(path, gray_rank(rotated.view(U64)), fp.view(U64)[:, None], radius)
        yield batch(src=pa.array(fp[i]), dst=pa.array(fp[j]))

    return filed.repartition(n, "path").mapInArrow(run, "src long, dst long")


def simhash_components(fps: DataFrame, key: str, radius: int, max_group: int = MAX_GROUP, split_bits: int = SPLIT_BITS) -> DataFrame:
    """``fps`` (key, fp) with ``component``: the smallest key reachable by steps of ``radius`` bits, itself included.

    Copies share a fingerprint and are collapsed before anything is compared. Null keys get the component of their
    fingerprint and never name one, unless all keys of a component are null: then it is null.
    """
    distinct = materialize(fps.groupBy("fp").agg(F.min(key).alias("low")), "distinct")
    links = hamming_links(distinct.select("fp"), radius, distinct.count(), max_group, split_bits)
    parts = connected_components(links)
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    low = named.groupBy("part").agg(F.min("low").alias("component"))
    return fps.join(named.select("fp", "part").join(low, "part").select("fp", "component"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, radius: int = 2, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per document: ``(key, fp, component)``. Documents link if their SimHash fingerprints differ in ``radius``
    bits or fewer; blank and null texts share the fingerprint zero. Repeated rows stay repeated. An empty table gives
    an empty one."""
    return simhash_components(materialize(fingerprints(docs, key, text, k).drop("sketch"), "fps"), key, radius, max_group)


def op7_query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
