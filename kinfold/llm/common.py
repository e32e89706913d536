"""Helpers of the operators in this package: text batches, segment sums, 64-bit mixing."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK64 = (1 << 64) - 1


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def release() -> None:
    """Free what is unreachable and give it back: a Python worker outlives its tasks and shares its executor's memory."""
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): equal inputs only have equal outputs."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bit_counts(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For consecutive segments of ``h`` (uint64) with ``lens`` members: how many have each bit, as (segments, 64).

    Eight bits are summed at once in the byte lanes of a word, 255 members at a time so that no lane overflows.
    """
    out = np.zeros((len(lens), 64), np.int64)
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    n = lens[full]
    starts = (np.cumsum(lens) - lens)[full]
    chunks = -(-n // 255)
    first = np.cumsum(chunks) - chunks
    at = np.repeat(starts, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    for k in range(8):
        lanes = np.add.reduceat((h >> U64(k)) & U64(0x0101010101010101), at)
        out[full, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def majority(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """SimHash of each segment as uint64: a bit is set if over half the members have it; zero for empty segments."""
    bits = (2 * bit_counts(h, lens) > lens[:, None]).astype(U64)
    return (bits << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64)
