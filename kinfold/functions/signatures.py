"""Dual 64-bit signatures of texts and vectors, their text form and their distance."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinfold.runtime import spread

#: Words of a text: runs of other than ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Words whose bits are counted at once.
COUNTED = 65_536


def _majority(digests: list[bytes]) -> int:
    """SimHash of 64-bit numbers given as eight bytes, the highest first: the bits that over half of them have, signed."""
    counts = np.zeros(64, np.int64)
    for s in range(0, len(digests), COUNTED):
        some = np.frombuffer(b"".join(digests[s : s + COUNTED]), ">u8").astype("<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(digests), bitorder="little").view("<i8")[0])


def text_signatures(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, phash, dhash)``: SimHash of the lower-cased words, and of adjacent word pairs (0 for a single word), by the
    first 64 bits of their md5.

    A text without words, null ones among them, has null signatures, as a file that cannot be read. Rows are worked on
    one by one, so nothing is shuffled but a small scan over the cores.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            known: dict[bytes, bytes] = {}
            found: list[tuple[int | None, int | None]] = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()
                for w in words:
                    if w not in known:
                        known[w] = md5(w).digest()[:8]
                one = _majority([known[w] for w in words]) if words else None
                two = _majority([md5(x + b" " + y).digest()[:8] for x, y in pairwise(words)]) if len(words) > 1 else 0
                found.append((one, two if words else None))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))], [key, "phash", "dhash"])

    schema = StructType([texts.schema[key], StructField("phash", LongType()), StructField("dhash", LongType())])
    return spread(texts.select(key, F.lower(F.col(text)).alias("text"))).mapInArrow(run, schema)


def vector_signature(vector: Column) -> tuple[Column, Column]:
    """Signatures of a vector of up to 64 numbers: bit i of the first if component i is above the median, of the second
    if component i + 1 is above component i."""
    n = F.size(vector)
    ordered = F.sort_array(vector)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")).cast("double") + F.get(ordered, F.floor(n / 2).cast("int")).cast("double")) / 2
    at = F.sequence(F.lit(0), F.least(n, F.lit(64)) - 1)

    def bits(test) -> Column:
        return F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: F.when(test(i), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc))

    above = bits(lambda i: F.get(vector, i).cast("double") > middle)
    rising = bits(lambda i: F.coalesce(F.get(vector, i + 1) > F.get(vector, i), F.lit(False)))
    usable = vector.isNotNull() & (n > 0)
    return F.when(usable, above), F.when(usable, rising)


def to_hex(phash: Column, dhash: Column) -> Column:
    """``<16 hex>|<16 hex>``."""
    return F.concat_ws("|", *[F.when(h.isNotNull(), F.lpad(F.lower(F.hex(h)), 16, "0")) for h in (phash, dhash)])


def from_hex(text: Column) -> tuple[Column, Column]:
    """Both signatures of their text form. A single number, as older stores have it, stands for both; what is not hex
    gives null."""
    parts = F.split(text, r"\|")
    number = lambda s: F.when(s.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(s, 16, -10).cast("long"))
    first = number(F.get(parts, F.lit(0)))
    return first, F.when(F.size(parts) > 1, number(F.get(parts, F.lit(1)))).otherwise(first)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distance(a_phash: Column, a_dhash: Column, b_phash: Column, b_dhash: Column) -> Column:
    """The larger of the two Hamming distances."""
    return F.greatest(hamming(a_phash, b_phash), hamming(a_dhash, b_dhash))


def group_id(paths: Column) -> Column:
    """Eight hex digits that depend on the set of member paths only."""
    return F.substring(F.md5(F.array_join(F.array_sort(F.array_distinct(paths)), "|").cast("binary")), 1, 8)
