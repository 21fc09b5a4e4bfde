"""The most frequent word n-grams of each scope and their mean weights, counted by number in the tasks.

An n-gram is no more frequent than its words. Once the words are counted, the `max_terms`-th of those that are allowed gives a
total that every term of the vocabulary reaches, so only n-grams of words that reach it are counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from ..session import broadcast_if_small, cut_lineage
from . import ranking, tfidf
from .neighbours import split_words, tenants
from .phrases import pieces


def _flags(words: pa.Array, number: np.ndarray, owner: np.ndarray, wanted: list) -> np.ndarray:
    """Which occurrences are of a word wanted in their scope."""
    pairs, inverse = np.unique(owner * len(words) + number, return_inverse=True)
    known = words.to_pylist()
    return np.array([known[x % len(words)] in wanted[x // len(words)] for x in pairs.tolist()], bool)[inverse]


def _grams(words: pa.Array, number: np.ndarray, row: np.ndarray, owner: np.ndarray, n: int, use: np.ndarray) -> tuple:
    """Runs of `n` used words: the row and the group of each, and scope and text of each group of equal ones."""
    at = np.flatnonzero(row[n - 1:] == row[: max(len(row) - n + 1, 0)])
    for j in range(n):
        at = at[use[at + j]]
    group = owner[at]
    for j in range(n):
        first, group = np.unique(group * len(words) + number[at + j], return_index=True, return_inverse=True)[1:]
    parts = [words.take(pa.array(number[at[first] + j])) for j in range(n)]
    text = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
    return row[at], group, owner[at[first]], text


def _keys(piece: pa.RecordBatch, scope: Sequence[str], first: np.ndarray) -> list:
    return list(zip(*(piece.column(c).take(pa.array(first)).to_pylist() for c in scope))) if scope else [()]


def _by_scope(rows: DataFrame, scope: Sequence[str], *values: str) -> dict:
    held: dict = {}
    for r in rows.select(*scope, *values).collect():  # checked by the callers
        held.setdefault(tuple(r[c] for c in scope), []).append(tuple(r[v] for v in values))
    return held


def gram_counts(rows: DataFrame, scope: Sequence[str], sizes: Sequence[int], words: DataFrame | None = None) -> DataFrame:
    """(scope, term, df, total) of n-grams of the given sizes in rows of `neighbours.joined_words`, each a document. With `words`
    (scope, term), checked to be few, only n-grams of these words are counted."""
    scope = list(scope)
    sent = rows.sparkSession.sparkContext.broadcast(None if words is None else {k: {t for t, in v} for k, v in _by_scope(words, scope, "term").items()})
    schema = ST.StructType([*rows.select(*scope).schema.fields, *ST.StructType.fromDDL("term STRING, df BIGINT, total BIGINT").fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                split = split_words(piece)
                tenant, first = tenants(piece, scope)
                owner = tenant[split[2]]
                use = np.ones(len(owner), bool) if sent.value is None else _flags(*split[:2], owner, [sent.value.get(k, ()) for k in _keys(piece, scope, first)])
                for n in sizes:
                    row, group, who, text = _grams(*split, owner, n, use)
                    total = np.bincount(group, minlength=len(text))
                    df = np.bincount(np.unique(group * piece.num_rows + row) // piece.num_rows, minlength=len(text))
                    owners = [piece.column(c).take(pa.array(first[who])) for c in scope]
                    yield pa.RecordBatch.from_arrays([*owners, text, pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=schema.names)

    counted = rows.select(*scope, "_k", "_t").mapInArrow(count, schema)
    return counted.groupBy(*scope, "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(rows: DataFrame, n_table: DataFrame, scope: Sequence[str], high: int, max_terms: int, min_df: int, max_df: float) -> DataFrame | None:
    """(scope, term, idf) as `tfidf.vocabulary` gives it for 1- to `high`-grams, or None where the words to be sent to the tasks
    are too many. `n_table` (scope, n_docs) counts the documents."""
    scope = list(scope)
    words = cut_lineage(gram_counts(rows, scope, [1]))
    allowed = tfidf.allowed_terms(words, n_table, min_df, max_df, scope)
    last = ranking.top_k(allowed, scope, [F.desc("total"), F.asc("term")], max_terms).where(F.col("rank") == max_terms)
    floor = n_table.join(last.select(*scope, F.col("total").alias("_least")), scope, "left")
    floor = floor.select(*scope, F.coalesce("_least", F.least(F.lit(min_df), "n_docs")).alias("_least"))
    often = cut_lineage(words.join(floor, scope).where(F.col("total") >= F.col("_least")).select(*scope, "term"))
    if broadcast_if_small(often) is often:
        return None
    runs = gram_counts(rows, scope, range(2, high + 1), often)
    return tfidf.most_frequent(tfidf.allowed_terms(words.unionByName(runs), n_table, min_df, max_df, scope), max_terms, scope)


def total_weights(rows: DataFrame, vocab: DataFrame, scope: Sequence[str], high: int) -> DataFrame:
    """(scope, term, total): the normalised weights of each term of `vocab` (scope, term, idf) added up over the documents. The
    caller has checked that the vocabulary is small; a task passes on at most a row per term."""
    scope = list(scope)
    held = _by_scope(vocab, scope, "term", "idf")
    terms = [(key, term, idf) for key, items in held.items() for term, idf in items]
    places: dict = {}
    for i, (key, term, _) in enumerate(terms):
        places.setdefault(key, {})[term] = i
    runs = {key: {w for t in of if " " in t for w in t.split(" ")} for key, of in places.items()}
    sent = rows.sparkSession.sparkContext.broadcast((terms, places, runs))
    schema = ST.StructType([*vocab.select(*scope).schema.fields, *ST.StructType.fromDDL("term STRING, total DOUBLE").fields])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, places, runs = sent.value
        idf, sums = np.array([x[2] for x in terms]), np.zeros(len(terms))
        for batch in batches:
            for piece in pieces(batch):
                split = split_words(piece)
                tenant, first = tenants(piece, scope)
                owner, keys = tenant[split[2]], _keys(piece, scope, first)
                cells = []
                for n in range(1, high + 1):
                    wanted = places if n == 1 else runs
                    use = _flags(*split[:2], owner, [wanted.get(k, ()) for k in keys]) if n < 3 else use
                    row, group, who, text = _grams(*split, owner, n, use)
                    at = np.array([places.get(keys[w], {}).get(t, -1) for w, t in zip(who.tolist(), text.to_pylist())], np.int64)[group]
                    cells.append(row[at >= 0] * len(terms) + at[at >= 0])
                cell, tf = np.unique(np.concatenate(cells), return_counts=True)
                row, term = cell // max(len(terms), 1), cell % max(len(terms), 1)
                weight = tf * idf[term]
                norm = np.sqrt(np.bincount(row, weight * weight, piece.num_rows))
                sums += np.bincount(term, weight / norm[row], len(terms))
        seen = np.flatnonzero(sums)
        owners = [pa.array([terms[i][0][j] for i in seen], to_arrow_type(schema[c].dataType)) for j, c in enumerate(scope)]
        yield pa.RecordBatch.from_arrays([*owners, pa.array([terms[i][1] for i in seen], pa.string()), pa.array(sums[seen])], names=schema.names)

    return rows.select(*scope, "_k", "_t").mapInArrow(add, schema).groupBy(*scope, "term").agg(F.sum("total").alias("total"))
