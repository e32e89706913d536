"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is a set of paragraph cells: stretches of the words of a line that end after words chosen by their own hash, so
an edit changes the cells around it and no others. A cell that occurs n times counts as n members. Each member adds its
64-bit digest, a checksum and a count to one place in each of three subtables. Subtracting the sketch of another version
cancels what both have; peeling places that hold a single member recovers the digests that only one of them has. If
more differ than a sketch of this size can give back, both texts are sketched again, four times as large, and so on.

The fingerprint of a text is its sketch at the first size. Likeness is the Jaccard similarity of the two sets, which
follows from their sizes and the number of recovered differences. Where the fingerprints give all differences back, the
likeness is theirs alone; else it comes from the larger sketches, which are made of the texts again and are not put out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kinfold.llm.common import U64, batch, mix

#: Places of a subtable at the first size, as a power of two, and at the last, where sets are compared outright.
FIRST, LAST, GROWTH = 3, 19, 2
TABLES = 3
#: A cell ends after a word whose checksum is divisible by this: its mean length in words.
CELL_WORDS = 4
#: Members that are sketched together.
TOGETHER = 150_000


def cells(text: bytes) -> np.ndarray:
    """Digests of the paragraph cells of a text, in order; repeats differ by their number."""
    seen: dict[bytes, int] = {}
    out = []
    for line in text.split(b"\n"):
        words = line.split()
        first = 0
        ends = [i + 1 for i, w in enumerate(words) if not zlib.crc32(w) % CELL_WORDS]
        if words and (not ends or ends[-1] < len(words)):
            ends.append(len(words))
        for e in ends:
            cell = b" ".join(words[first:e])
            first = e
            n = seen.get(cell, 0)
            seen[cell] = n + 1
            out.append(xxhash.xxh64_intdigest(cell, n))
    return np.array(out, U64)


def places(keys: np.ndarray, power: int) -> np.ndarray:
    """The place of each key in each subtable, as (keys, TABLES), for subtables of 2**power places. Halving a subtable
    adds its upper half to its lower half."""
    h = mix(keys ^ U64(0x5851F42D4C957F2D))
    return np.stack([((h >> U64(20 * t)) & U64((1 << power) - 1)).astype(np.int64) + (t << power) for t in range(TABLES)], axis=1)


def checksum(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)


class Sketches:
    """Sketches of several sets at one size: count, sum of keys and sum of checksums (both by xor) of each place."""

    def __init__(self, sets: int, power: int):
        self.power, self.width = power, TABLES << power
        self.count = np.zeros(sets * self.width, np.int32)
        self.key = np.zeros(sets * self.width, U64)
        self.check = np.zeros(sets * self.width, np.uint32)

    def add(self, which: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = (places(keys, self.power) + which[:, None] * self.width).ravel()
        np.add.at(self.count, at, np.repeat(np.broadcast_to(np.int32(sign), len(keys)), TABLES))
        np.bitwise_xor.at(self.key, at, np.repeat(keys, TABLES))
        np.bitwise_xor.at(self.check, at, np.repeat(checksum(keys), TABLES))

    def peel(self, sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recover members until no place holds just one: (set, key, sign) of each, and which sets came out whole."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            look = look[(np.abs(self.count[look]) == 1)]
            look = look[checksum(self.key[look]) == self.check[look]]
            if not len(look):
                break
            who, key, sign = look // self.width, self.key[look], self.count[look]
            _, one = np.unique(np.stack([who.astype(U64), key], axis=1), axis=0, return_index=True)
            who, key, sign = who[one], key[one], sign[one]
            found.append((who, key, sign))
            self.add(who, key, -sign)
            look = np.unique((places(key, self.power) + who[:, None] * self.width).ravel())
        rest = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(sets, self.width).any(axis=1)
        who, key, sign = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, U64, np.int32)))
        return who, key, sign, ~rest


def fingerprint(keys: np.ndarray, power: int = FIRST) -> str:
    """The sketch of a set as text: its size, then counts, key sums and checksums in little-endian base64."""
    s = Sketches(1, power)
    s.add(np.zeros(len(keys), np.int64), keys)
    return f"{len(keys)}:" + base64.b64encode(s.count.astype("<i4").tobytes() + s.key.astype("<u8").tobytes() + s.check.astype("<u4").tobytes()).decode()


def differences(pairs: list[tuple[np.ndarray, np.ndarray]], power: int = FIRST) -> list[tuple[np.ndarray, np.ndarray]]:
    """For pairs of sets: the digests that only the first and only the second has, through sketches that grow until
    they give all back."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U64),) * 2] * len(pairs)
    todo = list(range(len(pairs)))
    while todo and power <= LAST:
        failed = []
        per = max(1, TOGETHER // (TABLES << power))
        for s in range(0, len(todo), per):
            part = todo[s : s + per]
            t = Sketches(len(part), power)
            for side, sign in ((0, 1), (1, -1)):
                lens = [len(pairs[i][side]) for i in part]
                t.add(np.repeat(np.arange(len(part)), lens), np.concatenate([pairs[i][side] for i in part]), sign)
            who, key, sign, whole = t.peel(len(part))
            by = np.argsort(who, kind="stable")
            who, key, sign = who[by], key[by], sign[by]
            cut = np.searchsorted(who, np.arange(len(part) + 1))
            for x, i in enumerate(part):
                if whole[x]:
                    k, g = key[cut[x] : cut[x + 1]], sign[cut[x] : cut[x + 1]]
                    out[i] = (k[g > 0], k[g < 0])
                else:
                    failed.append(i)
        todo, power = failed, power + GROWTH
    for i in todo:
        out[i] = (np.setdiff1d(*pairs[i]), np.setdiff1d(pairs[i][1], pairs[i][0]))
    return out


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Jaccard similarity of each pair of sets; 1 for two empty ones."""
    out = []
    for (a, b), (x, y) in zip(pairs, differences(pairs), strict=True):
        both = (len(a) + len(b) - len(x) - len(y)) / 2
        every = len(a) + len(b) - both
        out.append(both / every if every else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """A text whose last quarter of code points is replaced by the first as many of another."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs(key, text)`` dealt by ranges as ``(part, copy, key, text)``, sorted: within a part, the row after each row is
    its successor, and a row with ``copy`` 1 at its end is the successor of the part's last row.

    Rows are ordered by key, nulls first, then by a hash of the text, then by the text; the successor of the last is the
    first. Ranges are cut at approximate quantiles of the keys; a key that fills several, and null keys, are dealt by the
    hash. What the driver sees is one key and hash for each range.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be a column of whole numbers")
    # Flipping the highest bit lets signed order be that of the unsigned hash.
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), mark.alias("mark"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = Counter(docs.approxQuantile("key", [i / (4 * n) for i in range(1, 4 * n)], 0.1 / n))
    rows = docs.agg(F.count("*").alias("all"), F.count("key").alias("some")).first()
    nulls = 1 + 4 * n * (rows["all"] - rows["some"]) // max(1, rows["all"])
    # Parts in order: null keys, keys before the first cut, and for each cut that key itself, if it fills several ranges, and those after it.
    limits, at = np.array(sorted(cuts), np.float64), nulls + 1
    own, own_parts, after = [], [], [nulls]
    for c in limits.tolist():
        own_parts.append(cuts[c])
        own.append(at)
        at += cuts[c] if cuts[c] > 1 else 0
        after.append(at)
        at += 1
    own, own_parts, after = np.array(own, np.int64), np.array(own_parts, np.int64), np.array(after, np.int64)

    @F.pandas_udf("int")
    def part(keys: pd.Series, marks: pd.Series) -> pd.Series:
        share = (marks.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        dealt = lambda parts: (share * np.asarray(parts, np.uint64) >> np.uint64(32)).astype(np.int64)
        k = keys.fillna(-np.inf).to_numpy(np.float64)
        i = np.searchsorted(limits, k, side="right")
        out = after[i]
        if len(limits):
            j = np.maximum(i - 1, 0)
            hot = (i > 0) & (limits[j] == k) & (own_parts[j] > 1)
            out = np.where(hot, own[j] + dealt(own_parts[j]), out)
        return pd.Series(np.where(keys.isna(), dealt(nulls), out).astype(np.int32))

    cut = docs.withColumn("part", part("key", "mark"))
    firsts = cut.groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull().alias("some"), "key", "mark")).alias("first")).collect()
    firsts = sorted((r["part"], r["first"]["key"], r["first"]["mark"]) for r in firsts)
    heads = [(p, k, m, firsts[i - 1][0]) for i, (p, k, m) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(heads, "part int, key long, mark long, before int"))  # a row for each range
    first = (cut["part"] == heads["part"]) & cut["key"].eqNullSafe(heads["key"]) & (cut["mark"] == heads["mark"])
    copies = cut.join(heads, first).groupBy("before", cut["key"], cut["mark"]).agg(F.min("text").alias("text"))
    sent = cut.select("part", F.lit(0).alias("copy"), "key", "text", "mark").unionAll(copies.select(F.col("before").alias("part"), F.lit(1).alias("copy"), "key", "text", "mark"))
    sent = sent.repartition(n, "part").sortWithinPartitions("part", "copy", F.asc_nulls_first("key"), "mark", F.asc_nulls_first("text"))
    return sent.select("part", "copy", "key", "text")


def compare_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The next document follows in the order of ``with_next``; a lone document follows itself. Null texts are empty.
    Repeated rows are documents of their own; a null key comes first. Keys that are no whole numbers raise. Other columns
    are not read.
    """

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """Rows of (key, text, cells, next text, next cells)."""
        new = [edited(t, f) for _, t, _, f, _ in rows]
        own = [c for _, _, c, _, _ in rows]
        after = [cells(t.encode()) for t in new]
        near = likeness(list(zip(own, after, strict=True)) + [(c, x) for _, _, c, _, x in rows])
        return batch(
            key=pa.array([r[0] for r in rows], pa.int64()),
            n_chars=pa.array([len(r[1]) for r in rows], pa.int64()),
            edited_sha256=pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
            fingerprint=pa.array([fingerprint(c) for c in own]),
            edited_fingerprint=pa.array([fingerprint(c) for c in after]),
            near_edited=pa.array(near[: len(rows)]),
            near_next=pa.array(near[len(rows) :]),
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ready, size = None, [], 0
        for b in it:
            for part, copy, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                row = (part, key, text, cells(text.encode()))
                if held is not None:
                    ready.append((*held[1:], text, row[3]))
                    size += len(held[3]) + len(row[3])
                held = None if copy else row
            if ready and size > TOGETHER or len(ready) > 2000:
                yield finish(ready)
                ready, size = [], 0
        if ready:
            yield finish(ready)

    out = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInArrow(run, out).withColumnRenamed("key", key)


def op8_query(docs: DataFrame) -> DataFrame:
    return compare_versions(docs)
