"""Upper bounds of counts by hash buckets, kept as one bit for each bucket: those whose count is large enough.

A task adds up what falls into each bucket and sends the buckets that are not empty, in slices of SLICE buckets, with
counts capped at the threshold (a capped sum reaches the threshold exactly when the whole sum does). Slices are summed
where they meet, and only their bits go through the driver: width / 8 bytes, whatever the corpus's size. Several keys may
share a bucket, so a set bit is an upper bound: what has none is certainly rarer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 16
SLICES = "slice int, data binary"
#: Buckets at most: their bits take 16 MB.
WIDEST = 1 << 27


def width_for(keys: float, least: int = 1 << 13) -> int:
    """A power of two of at least so many buckets, within bounds."""
    return min(WIDEST, max(least, 1 << int(np.ceil(np.log2(max(keys, 1))))))


class Counts:
    """A task's counts by bucket; memory holds what is not empty."""

    def __init__(self, width: int, least: int):
        self.width, self.least, self.parts, self.held = width, least, [], 0

    def add(self, buckets: np.ndarray, counts: np.ndarray | None = None) -> None:
        """buckets may repeat; counts: what each stands for, 1 if not given."""
        buckets = buckets.astype(np.uint32)
        if counts is None:
            found, total = np.unique(buckets, return_counts=True)
        else:
            found, at = np.unique(buckets, return_inverse=True)
            total = np.bincount(at, counts, len(found)).astype(np.int64)
        self.parts.append((found, np.minimum(total, self.least)))
        self.held += len(found)
        if self.held > 1 << 22 and len(self.parts) > 1:
            self._settle()

    def _settle(self) -> None:
        found, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        total = np.bincount(at, np.concatenate([p[1] for p in self.parts]), len(found)).astype(np.int64)
        self.parts, self.held = [(found, np.minimum(total, self.least))], 0

    def slices(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._settle()
        found, total = self.parts[0]
        edges = np.searchsorted(found, np.arange(0, self.width + SLICE, SLICE, dtype=np.int64))
        for k in np.flatnonzero(np.diff(edges)):
            own = slice(edges[k], edges[k + 1])
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([_packed(found[own] - np.uint32(k * SLICE), total[own], self.least)], pa.binary())], ["slice", "data"])


def _count_type(least: int) -> type:
    return np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32


def _packed(places: np.ndarray, counts: np.ndarray, least: int) -> bytes:
    """Steps from place to place, their low bytes before their high ones, which are mostly zero; then the counts."""
    steps = np.diff(places, prepend=np.uint32(0)).astype("<u2").view(np.uint8).reshape(-1, 2)
    return steps[:, 0].tobytes() + steps[:, 1].tobytes() + counts.astype(_count_type(least)).tobytes()


def _unpacked(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype(_count_type(least))
    n = len(data) // (2 + kind.itemsize)
    steps = np.frombuffer(data, np.uint8, 2 * n).reshape(2, n).astype(np.int64)
    return np.cumsum(steps[0] + (steps[1] << 8)), np.frombuffer(data, kind, n, 2 * n).astype(np.uint32)


def reached(slices: DataFrame, width: int, least: int) -> np.ndarray:
    """The bits (packed, lowest first) of the buckets whose counts add up to at least least."""
    each = min(width, SLICE)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places, counts = _unpacked(data, least)
                total = sums.setdefault(k, np.zeros(each, np.uint32))
                total[places] = np.minimum(total[places] + counts, np.uint32(least))
        for k, total in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["slice", "data"])

    bits = np.zeros(width // 8, np.uint8)
    for row in slices.repartition("slice").mapInArrow(add, SLICES).toLocalIterator():
        bits[row["slice"] * each // 8 : (row["slice"] + 1) * each // 8] = np.frombuffer(row["data"], np.uint8)
    return bits


def has(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Whether each bucket's bit is set."""
    return (bits[buckets >> np.uint64(3)] >> (buckets & np.uint64(7)).astype(np.uint8)) & 1 == 1
