"""Counts of words and of their neighbours, without moving what is rare.

Words are numbered inside a piece of text and counted by number, so no row is made for an occurrence. Pairs that may occur
`least` times are found by a bit filter (`phrases.suspects`); a triple is only counted where its pairs are suspected. What the
filter lets through by chance is refuted by the count behind the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .phrases import held, pieces, suspects

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def joined_words(docs: DataFrame, scope: Sequence[str], words: Column, *keep: str) -> DataFrame:
    """(scope, keep, _k, _t): key of the scope and the words with blanks between; rows without words are left out."""
    key = F.xxhash64(*scope) if scope else F.lit(0).cast("bigint")
    rows = docs.select(*scope, *keep, key.alias("_k"), F.array_join(words, " ").alias("_t"))
    return rows.where(F.col("_t") != "")


def split_words(piece: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a piece, the number of each word and the row it is in."""
    lists = pc.split_pattern(piece.column("_t"), " ")
    words = pc.list_flatten(lists).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy()


def tenants(piece: pa.RecordBatch, scope: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's scope and a row that each number stands for."""
    if not scope:
        return np.zeros(piece.num_rows, np.int64), np.zeros(1, np.int64)
    of: dict = {}
    number = [of.setdefault(key, len(of)) for key in zip(*(piece.column(c).to_pylist() for c in scope))]
    return np.array(number, np.int64), np.unique(number, return_index=True)[1]


def _pair_keys(piece: pa.RecordBatch, words: pa.Array, number: np.ndarray, row: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pairs with `gap` between their places in one text, and keys that pairs of any gap share."""
    at = np.flatnonzero(row[gap:] == row[: max(len(row) - gap, 0)])
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    keys = piece.column("_k").to_numpy().view(np.uint64)[row[at]]
    for place in (at, at + gap):
        keys = (keys ^ hashes[number[place]]) * _MIX[0]
        keys ^= keys >> np.uint64(29)
    return at, keys * _MIX[1]


def _counted(parts: list[np.ndarray], tags: list[np.ndarray], kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values of all parts and how often each tag comes with them, a row per value."""
    values, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    cell = inverse * kinds + np.concatenate(tags)
    return values, np.bincount(cell, minlength=len(values) * kinds).reshape(-1, kinds)


def neighbour_counts(docs: DataFrame, words: Column, scope: Sequence[str], window: int, least: int) -> DataFrame:
    """(scope, a, b, c, n, near, far): words (b null), pairs (c null) and neighbouring triples.

    `n` counts pairs less than `window` places apart, `near` and `far` those one and two places apart; of words and
    triples it is the number of occurrences. Every pair with `least` occurrences in all is there with its counts, and every triple
    with as many; words are all there.
    """
    scope, gaps = list(scope), range(1, max(window, 3))
    rows = joined_words(docs, scope, words)

    def keys_of(piece: pa.RecordBatch) -> np.ndarray:
        split = split_words(piece)
        return np.concatenate([_pair_keys(piece, *split, gap)[1] for gap in gaps])

    filled = suspects(rows.select("_k", "_t"), keys_of, least) if least > 1 else np.full(1, 255, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(filled)
    schema = ST.StructType([*rows.select(*scope).schema.fields, *ST.StructType.fromDDL("a STRING, b STRING, c STRING, n BIGINT, near BIGINT, far BIGINT").fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, number, row = split_words(piece)
                size = len(words)
                tenant, first = tenants(piece, scope)
                owner = tenant[row]
                starts = {gap: at[held(sent.value, keys)] for gap in gaps for at, keys in [_pair_keys(piece, words, number, row, gap)]}
                ones, n = np.unique(owner * size + number, return_counts=True)
                pairs, by_gap = _counted([(owner[at] * size + number[at]) * size + number[at + gap] for gap, at in starts.items()],
                                         [np.full(len(at), gap - 1) for gap, at in starts.items()], len(gaps))
                # all three pairs of a triple are suspected; its first pair is named by its place among `pairs`
                three = np.intersect1d(starts[1], starts[2], assume_unique=True)
                three = three[np.isin(three + 1, starts[1], assume_unique=True)]
                pair = np.searchsorted(pairs, (owner[three] * size + number[three]) * size + number[three + 1])
                triples, times = np.unique(pair * size + number[three + 2], return_counts=True)
                of_pair = pairs[triples // size] if len(triples) else triples
                who = np.concatenate([ones // size, pairs // size // size, of_pair // size // size])
                a = np.concatenate([ones % size, pairs // size % size, of_pair // size % size])
                b = np.concatenate([np.zeros(len(ones), np.int64), pairs % size, of_pair % size])
                c = np.concatenate([np.zeros(len(ones) + len(pairs), np.int64), triples % size])
                none = np.zeros(len(ones), np.int64), np.zeros(len(triples), np.int64)
                figures = [
                    np.concatenate([n, by_gap[:, : window - 1].sum(axis=1), times]),
                    *(np.concatenate([none[0], by_gap[:, i], none[1]]) for i in (0, 1)),
                ]
                texts = [words.take(pa.array(x, mask=np.arange(len(x)) < empty)) for x, empty in ((a, 0), (b, len(ones)), (c, len(ones) + len(pairs)))]
                owners = [piece.column(x).take(pa.array(first[who])) for x in scope]
                yield pa.RecordBatch.from_arrays([*owners, *texts, *(pa.array(x, pa.int64()) for x in figures)], names=schema.names)

    counted = rows.select(*scope, "_k", "_t").mapInArrow(count, schema)
    return counted.groupBy(*scope, "a", "b", "c").agg(*[F.sum(x).alias(x) for x in ("n", "near", "far")])
