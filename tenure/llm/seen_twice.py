"""Two Bloom filters over a stream of hashes: bits seen once, and bits seen at least twice.

A hash sets ``PROBES`` bits. A key that occurs twice has all its bits in the second
filter, so a test against that filter misses no repeat; the few other keys that pass
are removed later by an exact comparison.

The filters are built distributed: tasks send the positions they met once or more
often, cut into slices of the filter; one streaming pass per slice merges them. The
number of bits follows the number of rows up to ``MOST_BITS``, the proven bound of
what is broadcast; beyond it more keys pass the test and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenure.llm.common import mix

PROBES = 2
SLICE_BITS = 20
MOST_BITS = 29
SCHEMA = "slice int, once binary, twice binary"


def bits_for(rows: int, keys_per_row: int) -> int:
    """Logarithm of the filter size: 16 bits a key, between 2^20 and 2^29 (64 MB)."""
    return int(min(MOST_BITS, max(SLICE_BITS, np.ceil(np.log2(max(1, rows) * keys_per_row * 16)))))


def positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [(mix(hashes + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) >> shift).astype(np.uint32) for i in range(PROBES)]


class Collector:
    """Positions of one task, sent on as soon as ``most`` of them are held."""

    def __init__(self, bits: int, most: int = 4_000_000) -> None:
        self.bits, self.most, self.held, self.size = bits, most, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held += positions(hashes, self.bits)
        self.size += PROBES * len(hashes)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            found, times = np.unique(np.concatenate(self.held), return_counts=True)
            edges = np.searchsorted(found, np.arange(0, 2**self.bits + 1, 2**SLICE_BITS, dtype=np.uint64))
            rows = [(i, found[a:b], found[a:b][times[a:b] > 1]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1].tobytes() for r in rows], pa.binary()),
                    pa.array([r[2].tobytes() for r in rows], pa.binary()),
                ],
                names=["slice", "once", "twice"],
            )
        self.held, self.size = [], 0


def _merge(batches: Iterator[pa.RecordBatch], second: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice; one slice is held at a time."""
    width, now = 2**SLICE_BITS, None
    once, twice = np.zeros(width, bool), np.zeros(width, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([np.packbits(twice if second else once, bitorder="little").tobytes()], pa.binary())],
            names=["slice", "bits"],
        )

    for batch in batches:
        for number, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != now:
                if now is not None:
                    yield done()
                now = number
                once[:], twice[:] = False, False
            met = np.frombuffer(a, np.uint32) & np.uint32(width - 1)
            twice[met[once[met]]] = True
            twice[np.frombuffer(b, np.uint32) & np.uint32(width - 1)] = True
            once[met] = True
    if now is not None:
        yield done()


def merged(parts: DataFrame, bits: int, twice: bool = True) -> np.ndarray:
    """The second filter, or the first one, as packed bits (at most 2^29 / 8 bytes)."""
    slices = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(lambda b: _merge(b, twice), "slice int, bits binary")
    filter_ = np.zeros(2**bits // 8, np.uint8)
    size = 2**SLICE_BITS // 8
    for row in slices.collect():
        filter_[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return filter_


def maybe_twice(hashes: np.ndarray, filter_: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for p in positions(hashes, bits):
        found &= (filter_[p >> np.uint32(3)] >> (p & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return found
