"""Word n-grams that occur at least twice, without moving the others.

1. Every run of `low` words is a 36-bit position; tasks send sorted positions as packed blocks, about two bytes a
   word, and those that two runs share become a bit filter of bounded size.
2. A longer n-gram can only occur twice if each run of `low` words in it does. So each suspected start sends one text, as
   many words as may still repeat, and the n-grams that begin there are counted behind the shuffle, by text.

Positions shared by chance and a full filter add suspects, which the count by text refutes; nothing is missed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..session import cut_lineage

_BITS, _LOW_BITS = 36, 26  # of a position, and of its place in one of 1,024 buckets
_FILTER = (20, 30)  # bits of the filter as powers of two: 128 KB to 128 MB
_PIECE = 4 << 20  # bytes of text looked at together
_FLUSH = 4_000_000  # positions sent together


def run_lines(content: Column) -> Column:
    """Lower-cased word runs of a text, a sentence per line."""
    runs = F.transform(T.sentences(content), lambda s: F.array_join(F.regexp_extract_all(F.lower(s), F.lit(T.RUN), F.lit(0)), " "))
    return F.coalesce(F.array_join(runs, "\n"), F.lit(""))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about `_PIECE` bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("_t")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PIECE, "right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _starts(piece: pa.RecordBatch, low: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their line and row numbers, the starts of runs of `low` words, and the 64-bit keys of these runs."""
    lines = pc.split_pattern(piece.column("_t"), "\n")
    row_of_line = pc.list_parent_indices(lines).to_numpy()
    words = pc.split_pattern(pc.list_flatten(lines), " ")
    line = pc.list_parent_indices(words).to_numpy()
    words = pc.list_flatten(words).dictionary_encode()
    hashes = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)[words.indices.to_numpy()]
    row = row_of_line[line]
    at = np.flatnonzero(line[low - 1 :] == line[: len(line) - low + 1]) if len(line) >= low else np.zeros(0, np.int64)
    keys = piece.column("_k").to_numpy().view(np.uint64)[row[at]]
    for j in range(low):
        keys = (keys ^ hashes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return words, line, row, at, keys * np.uint64(0xBF58476D1CE4E5B9)


def _pack(places: np.ndarray) -> bytes:
    """Sorted places as their differences, byte by byte: the upper bytes are nearly all zero."""
    return np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _blocks(parts: list[np.ndarray], least: int) -> pa.RecordBatch:
    """Positions by bucket, each `least` times at most."""
    places = np.sort(np.concatenate(parts))
    places = places[np.concatenate([[True] * min(least, len(places)), places[least:] != places[:-least]])]
    buckets, first = np.unique(places >> _LOW_BITS, return_index=True)
    packed = [_pack(p & ((1 << _LOW_BITS) - 1)) for p in np.split(places, first[1:])]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "places"])


def suspects(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], least: int = 2, most_bits: int = _FILTER[1]) -> np.ndarray:
    """Bit filter of the positions that at least `least` of the 64-bit keys share, `2 ** most_bits` bits at most. `keys_of` gives
    the keys of a piece of (_k, _t)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for piece in pieces(batch):
                held.append((keys_of(piece) >> np.uint64(64 - _BITS)).astype(np.int64))
                if sum(map(len, held)) >= _FLUSH:
                    yield _blocks(held, least)
                    held = []
        if any(map(len, held)):
            yield _blocks(held, least)

    def shared_by(group: pa.Table) -> pa.Table:
        places = np.sort(np.concatenate([_unpack(p) for p in group.column("places").to_pylist()]))
        often = np.unique(places[least - 1:][places[least - 1:] == places[:len(places) - least + 1]])
        some = int(len(often) > 0)
        return pa.table({"bucket": group.column("bucket").slice(0, some), "places": pa.array([_pack(often)][:some], pa.binary()),
                         "n": pa.array([len(often)][:some], pa.int64())})

    blocks = rows.mapInArrow(send, "bucket int, places binary")
    shared = cut_lineage(blocks.groupBy("bucket").applyInArrow(shared_by, "bucket int, places binary, n long"))
    n = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(most_bits, max(_FILTER[0], (16 * max(n, 1) - 1).bit_length()))
    size = 1 << (bits - (_BITS - _LOW_BITS) - 3)  # bytes of a bucket

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket"), batch.column("places"), strict=True):
                bit = np.zeros(size * 8, np.uint8)
                bit[_unpack(packed.as_py()) >> (_BITS - bits)] = 1
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()], pa.int32()), pa.array([np.packbits(bit, bitorder="little").tobytes()])], names=["bucket", "bits"])

    filled = np.zeros(1 << (bits - 3), np.uint8)
    for r in shared.mapInArrow(fold, "bucket int, bits binary").toLocalIterator():
        filled[r.bucket * size : (r.bucket + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return filled


def held(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit set in a filter of `suspects`."""
    bit = keys >> np.uint64(64 - (len(filled) * 8).bit_length() + 1)
    return (filled[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def repeated_runs(docs: DataFrame, scope: Sequence[str], *, content: str, low: int, high: int, most_bits: int = _FILTER[1]) -> DataFrame:
    """(scope, _head, _run, _n): texts of `low` to `high` words, each with the number of starts that sent it.

    Every n-gram of these lengths that occurs twice in a scope is a beginning of some of these texts, as often as it
    occurs. `_head` follows from the scope and the first `low` words; rows of one `_head` lie in one partition.
    """
    scope = list(scope)
    rows = docs.select(*scope, F.xxhash64(*scope).alias("_k") if scope else F.lit(0).cast("bigint").alias("_k"), run_lines(F.col(content)).alias("_t"))
    filled = suspects(rows.select("_k", "_t"), lambda piece: _starts(piece, low)[4], 2, most_bits)
    sent = rows.sparkSession.sparkContext.broadcast(filled)
    schema = ST.StructType([*rows.select(*scope).schema.fields, ST.StructField("_head", ST.LongType()), ST.StructField("_run", ST.StringType()), ST.StructField("_n", ST.LongType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, line, row, at, keys = _starts(piece, low)
                hit = np.flatnonzero(held(sent.value, keys))
                if not len(hit):
                    continue
                at, keys = at[hit], keys[hit]
                # length of the chain of suspects from each start, cut at the end of a line
                ends = np.append(np.flatnonzero((np.diff(at) != 1) | (line[at[1:]] != line[at[:-1]])), len(at) - 1)
                chain = ends[np.searchsorted(ends, np.arange(len(at)))] - np.arange(len(at)) + 1
                length = np.minimum(chain, high - low + 1) + low - 1
                of: dict = {}
                tenant = [of.setdefault(key, i) for i, key in enumerate(zip(*(piece.column(c).to_pylist() for c in scope)))] if scope else [0] * piece.num_rows
                known = words.dictionary.to_pylist()
                text = [known[i] for i in words.indices.to_pylist()]
                seen: Counter = Counter(
                    (tenant[r], k, " ".join(text[i : i + n]))
                    for r, k, i, n in zip(row[at].tolist(), keys.view(np.int64).tolist(), at.tolist(), length.tolist(), strict=True)
                )
                first, heads, runs = zip(*seen)
                kept = [pc.take(piece.column(c), pa.array(first)) for c in scope]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(heads, pa.int64()), pa.array(runs, pa.string()), pa.array(list(seen.values()), pa.int64())], names=schema.names)

    return rows.mapInArrow(send, schema).repartition(*scope, "_head")
