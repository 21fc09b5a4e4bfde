"""TF-IDF search by number: words and pairs of neighbouring words, without a row for an occurrence or for a query and a document.

1. Words are counted in the tasks. Every term of the vocabulary reaches the total of the `max_terms`-th word, so only words that
   do get a number, and texts are kept as these numbers (0: any other word).
2. A pair that reaches this total in all has, in some part of the texts, at least its share of that part's words. Each part sends
   the pairs of which that holds; these are then counted exactly.
3. Documents are weighed where they lie and scored against all queries by matrix products; a run of rows passes on k of them a query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from ..session import broadcast_if_small, cut_lineage, kept_table
from . import ranking
from .neighbours import split_words
from .phrases import pieces

MAX_PAIRS = 4_000_000  # pairs that are counted by number; with more, terms are rows
_PART = 4_000_000  # words looked at together
_CELLS = 2_000_000  # weights or scores held at once
_QUERIES = 256  # queries in one matrix product


def _distinct_rows(kind: np.ndarray, row: np.ndarray, n_rows: int, kinds: int) -> np.ndarray:
    """In how many different rows each kind is."""
    keys = np.sort(kind * n_rows + row)
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return np.bincount(keys[first] // n_rows, minlength=kinds)


def word_counts(texts: DataFrame) -> DataFrame:
    """(term, df, total) of the words of `_t`, which lie between blanks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, number, row = split_words(piece)
                df, total = _distinct_rows(number, row, piece.num_rows, len(words)), np.bincount(number, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "total"])

    counted = texts.select("_t").mapInArrow(count, "term STRING, df BIGINT, total BIGINT")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _kind(words: Sequence[str]) -> np.dtype:
    return np.dtype("<u2" if len(words) < 1 << 16 else "<u4")


def numbered(texts: DataFrame, id_col: str, words: Sequence[str]) -> DataFrame:
    """(id, _t): the words of each text as packed numbers, from 1 as they lie in `words`, 0 for any other."""
    sent, kind = texts.sparkSession.sparkContext.broadcast(list(words)), _kind(words)
    schema = S.StructType([texts.schema[id_col], S.StructField("_t", S.BinaryType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            for piece in pieces(batch):
                own, of, row = split_words(piece)
                code = pc.fill_null(pc.index_in(own, value_set=known), -1).to_numpy(zero_copy_only=False) + 1
                ends = np.cumsum(np.bincount(row, minlength=piece.num_rows)) * kind.itemsize
                offsets = np.append(0, ends).astype("<i4")
                packed = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(code.astype(kind)[of].tobytes())])
                yield pa.RecordBatch.from_arrays([piece.column(id_col), packed], names=schema.names)

    return texts.select(id_col, "_t").mapInArrow(number, schema)


def _unpacked(piece: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of a piece and the row of each."""
    packed = piece.column("_t").to_pylist()
    number = np.frombuffer(b"".join(packed), kind).astype(np.int64)
    return number, np.repeat(np.arange(len(packed)), [len(p) // kind.itemsize for p in packed])


def _pairs(number: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and rows of neighbours that both have a number. A word's code is its number, a pair's is at least `size`."""
    at = np.flatnonzero((number[:-1] > 0) & (number[1:] > 0) & (row[:-1] == row[1:]))
    return number[at] * size + number[at + 1], row[at]


def frequent_pairs(rows: DataFrame, words: Sequence[str], least: int, n_words: int) -> DataFrame | None:
    """(code, df, total) of all pairs that occur at least `least` times, and of some others; None if more than `MAX_PAIRS` may.
    `n_words` is the number of all words, numbered or not."""
    size, kind, share = len(words) + 1, _kind(words), least / n_words * (1 - 1e-9)

    def part_of(parts: list[np.ndarray], n: int) -> pa.RecordBatch:
        codes, times = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes[times >= share * n], pa.int64())], names=["code"])

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for piece in (p for batch in batches for p in pieces(batch)):
            number, row = _unpacked(piece, kind)
            parts.append(_pairs(number, row, size)[0])
            n += len(number)
            if n >= _PART:
                yield part_of(parts, n)
                parts, n = [], 0
        if n:
            yield part_of(parts, n)

    found = cut_lineage(rows.select("_t").mapInArrow(suspect, "code BIGINT").distinct())
    if found.count() > MAX_PAIRS:
        return None
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(found.toPandas()["code"].to_numpy(np.int64)))  # checked above

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        df, total = np.zeros((2, len(known)), np.int64)
        for piece in (p for batch in batches for p in pieces(batch)):
            code, row = _pairs(*_unpacked(piece, kind), size)
            place = _places(known, code)
            row, place = row[place >= 0], place[place >= 0]
            total += np.bincount(place, minlength=len(known))
            df += _distinct_rows(place, row, piece.num_rows, len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (known, df, total)], names=["code", "df", "total"])

    counted = rows.select("_t").mapInArrow(count, "code BIGINT, df BIGINT, total BIGINT")
    return counted.groupBy("code").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _places(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where each code lies among the sorted `known` ones, -1 where it is none of them."""
    if not len(known):
        return np.full(len(codes), -1, np.int64)
    place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[place] == codes, place, -1)


def count_terms(docs: DataFrame, id_col: str, tokens: Column, max_terms: int) -> tuple[DataFrame, list[str], DataFrame] | None:
    """The texts by number, their numbered words, and (term, df, total, n_docs) of all 1- and 2-grams that may be among the `max_terms`
    most frequent. None where there is no word, or what tasks would hold is too much."""
    texts = kept_table(docs.select(id_col, F.coalesce(F.array_join(tokens, " "), F.lit("")).alias("_t")), "texts")
    n_docs, texts = texts.count(), texts.where(F.col("_t") != "")
    counts = kept_table(word_counts(texts), "words")
    last = counts.orderBy(F.desc("total"), F.asc("term")).limit(max_terms).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    if not last.n:
        return None
    least = last.least if last.n == max_terms else 1
    often = counts.where(F.col("total") >= least)
    if broadcast_if_small(often) is often:
        return None
    words = sorted(r.term for r in often.select("term").collect())  # checked above
    rows = kept_table(numbered(texts, id_col, words), "numbers")
    pairs = frequent_pairs(rows, words, least, counts.agg(F.sum("total")).first()[0])
    if pairs is None:
        return None
    names = rows.sparkSession.createDataFrame(list(enumerate(words, 1)), "number BIGINT, term STRING")
    left, right = (F.broadcast(names.select(F.col("number").alias(n), F.col("term").alias(t))) for n, t in (("_a", "a"), ("_b", "b")))
    size = F.lit(len(words) + 1)
    pairs = pairs.where(F.col("total") >= least).withColumns({"_a": F.floor(F.col("code") / size), "_b": F.col("code") % size})
    pairs = pairs.join(left, "_a").join(right, "_b").select(F.concat_ws(" ", "a", "b").alias("term"), "df", "total")
    return rows, words, often.select("term", "df", "total").unionByName(pairs).withColumn("n_docs", F.lit(n_docs))


def best_documents(rows: DataFrame, id_col: str, words: Sequence[str], vocab: DataFrame, query_w: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, id, score): the k best documents of every run of rows for each query, by the cosine of `vocab` (term, idf) weights.

    `query_w` (query_id, term, weight) are normalised. The caller has checked that both are few. Scores below `least` are left out.
    """
    size, kind, query_field = len(words) + 1, _kind(words), query_w.schema["query_id"]
    number = {w: i for i, w in enumerate(words, 1)}
    code_of = lambda term: int(np.polyval([number[w] for w in term.split(" ")], size))
    terms = sorted((code_of(r.term), r.idf) for r in vocab.collect())
    known, idf = np.array([t[0] for t in terms], np.int64), np.array([t[1] for t in terms], float)
    asked = [(r.query_id, code_of(r.term), r.weight) for r in query_w.collect()]
    names = list(dict.fromkeys(a[0] for a in asked))
    place = {name: i for i, name in enumerate(names)}
    wanted, column = np.unique(np.searchsorted(known, [a[1] for a in asked]).astype(np.int64), return_inverse=True)
    entries = column, np.array([place[a[0]] for a in asked], np.int64), np.array([a[2] for a in asked], float)
    sent = rows.sparkSession.sparkContext.broadcast((known, idf, names, wanted, entries))
    schema = S.StructType([query_field, rows.schema[id_col], S.StructField("score", S.DoubleType())])

    def weighed(piece: pa.RecordBatch, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and normalised weight of the piece's terms, by row."""
        number, row = _unpacked(piece, kind)
        pair, pair_row = _pairs(number, row, size)
        term = np.append(_places(known, np.arange(size))[number], _places(known, pair))
        row = np.append(row, pair_row)
        cell, tf = np.unique(row[term >= 0] * len(known) + term[term >= 0], return_counts=True)
        row, term = cell // len(known), cell % len(known)
        weight = tf * idf[term]
        return row, term, weight / np.sqrt(np.bincount(row, weight * weight, piece.num_rows))[row]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, names, wanted, (column, query, weight) = sent.value
        if not names:
            return
        of_term = np.full(len(known), -1, np.int64)
        of_term[wanted] = np.arange(len(wanted))
        floor = np.full(len(names), least, float)  # of each query: a score that k documents of this task reach
        step = max(k, _CELLS // max(len(wanted), _QUERIES))
        for piece in (p for batch in batches for p in pieces(batch)):
            piece = piece.take(pc.sort_indices(piece.column(id_col)))  # equal scores go to the smaller id
            row, term, part = weighed(piece, known, idf)
            row, col, part = (x[of_term[term] >= 0] for x in (row, of_term[term], part))
            found = []
            for start in range(0, piece.num_rows, step):
                n = min(step, piece.num_rows - start)
                low, high = np.searchsorted(row, [start, start + n])
                held = np.zeros((n, len(wanted)))
                held[row[low:high] - start, col[low:high]] = part[low:high]
                for first in range(0, len(names), _QUERIES):
                    own = (query >= first) & (query < first + _QUERIES)
                    block = np.zeros((len(wanted), min(_QUERIES, len(names) - first)))
                    block[column[own], query[own] - first] = weight[own]
                    which, at, value = best_of(held @ block, floor[first:first + _QUERIES])
                    found.append((which + first, at + start, value))
            which, at, value = (np.concatenate(x) for x in zip(*found))
            ids = pa.array([names[i] for i in which], to_arrow_type(query_field.dataType))
            yield pa.RecordBatch.from_arrays([ids, piece.column(id_col).take(pa.array(at)), pa.array(value)], names=schema.names)

    def best_of(total: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of the k best rows of each query (a column); raises the `floor` in place."""
        shares = total > 0
        total = np.floor(total * 10**ranking.SCORE_DIGITS + 0.5) / 10**ranking.SCORE_DIGITS
        if len(total) >= k:
            np.maximum(floor, np.partition(total, len(total) - k, axis=0)[len(total) - k], out=floor)
        at, which = np.nonzero(shares & (total >= floor))
        value = total[at, which]
        order = np.lexsort((at, -value, which))
        at, which, value = at[order], which[order], value[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        return which[rank < k], at[rank < k], value[rank < k]

    return rows.mapInArrow(score, schema)
