"""Once-seen and twice-seen Bloom filters over 64-bit hashes, built by all tasks together.

Every task marks its own hashes in two bit arrays: `once` (seen) and `twice` (seen again inside the task). Two
tasks are merged by once = a | b and twice = A | B | (a & b), bit by bit, so a hash that occurs twice anywhere
has all its bits in `twice`. Arrays travel as compressed segments, so what a task sends grows with its own
hashes, and the merge reads one segment at a time in segment order: its memory does not grow with the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 16  # bytes
HASHES = 2


def bits_for(rows: int, per_row: int) -> int:
    """Power of two of about `per_row` bits a row, between 2**20 and 2**31 (256 MB, the most that is ever sent).

    Above that size the filter lets more false suspects pass; they are shuffled and then refuted.
    """
    return 1 << min(31, max(20, (max(1, rows) * per_row - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of uint64 hashes, one row per hash function."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)])


def _or(filled: np.ndarray, where: np.ndarray) -> None:
    np.bitwise_or.at(filled, where >> np.uint64(3), np.left_shift(1, where & np.uint64(7)).astype(np.uint8))


def test(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where all bits of a hash are set."""
    where = positions(hashes, len(filled) * 8)
    return np.logical_and.reduce((filled[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8)) & 1)


def marks(hashes: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """The two arrays of one task, as (segment, once, twice)."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for part in hashes:
        distinct, n = np.unique(part, return_counts=True)
        again = (n > 1) | test(once, distinct)
        _or(twice, positions(distinct[again], bits).ravel())
        _or(once, positions(distinct, bits).ravel())
    for i in range(0, len(once), SEGMENT):
        a, b = once[i : i + SEGMENT], twice[i : i + SEGMENT]
        if a.any():
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([i // SEGMENT], pa.int32()), "once": [zlib.compress(a, 1)], "twice": [zlib.compress(b, 1)],
            })


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, once, twice = None, None, None
    for batch in batches:
        for segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
            if segment != current:
                if current is not None and twice.any():
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([current], pa.int32()), "twice": [zlib.compress(twice, 1)]})
                current, once, twice = segment, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if current is not None and twice.any():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([current], pa.int32()), "twice": [zlib.compress(twice, 1)]})


def seen_twice(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """The twice-seen filter of all rows: `hashes_of` gives the hashes of a batch. At most 256 MB reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return marks((hashes_of(b) for b in batches if b.num_rows), bits)

    parts = df.mapInArrow(mark, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary")
    filled = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", F.col("twice")).toLocalIterator():
        part = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        filled[row.segment * SEGMENT : row.segment * SEGMENT + len(part)] = part
    return filled
