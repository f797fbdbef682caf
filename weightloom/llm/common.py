"""What the operators on texts share: bounded Arrow slices, byte-level words, 64-bit hashes.

Texts are handled as UTF-8 bytes. ``SPACE_SEPARATED`` marks the bytes of words
``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` cuts at exactly these six characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[9, 10, 11, 12, 13, 32]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have about ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), np.int64)
        block = (np.cumsum(size) - size) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(int(a), int(b - a))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column as UTF-8, null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()), b"").to_pylist()


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column after one another, and where each row begins (n + 1 offsets)."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the first word of each row (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD
    h = (h ^ (h >> np.uint64(29))) * ODD2
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, taken eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * ODD2
    at = np.arange(len(starts))
    k = 0
    while len(at):
        left = size[at] - k
        h[at] = mix(h[at] ^ (eight[starts[at] + k] & BYTE_MASKS[np.minimum(left, 8)]))
        k += 8
        at = at[left > 8]
    return h


class Rolling:
    """Hashes of any run of consecutive items, from one prefix sum modulo 2^64."""

    def __init__(self, items: np.ndarray, base: int):
        n = len(items)
        step = np.full(n + 1, base, np.uint64)
        step[0] = 1
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(items * np.multiply.accumulate(step)[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * ODD)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
