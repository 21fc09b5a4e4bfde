"""Ranked lexical search with range-maximum tables over posting lists.

Documents are cut into segments as they lie in their splits. A task indexes a segment (posting lists of the terms that
queries ask for, with the score each posting gives, and a sparse table over every list that names the posting of largest
score in any range) and answers all queries on it by best-first search:

* An interval of documents is bounded by the sum, over the query's terms, of the largest score in that range of the list.
* The interval of largest bound is split at the document that holds the largest of these scores; that document is scored
  exactly, and both sides get bounds of their own.
* What cannot enter the query's best k any more is dropped. The best k travel on from segment to segment of a task.

Each task returns at most k rows a query, and these meet in two group limits. Corpus statistics (documents, terms,
document frequencies) come from one pass over all documents before.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import schema_of, stored
from marginalia.llm.decontaminate import words

_SEGMENT_DOCS = 16_384
_SEGMENT_POSTINGS = 1_500_000
_CELLS = 200_000  # numbers of (intervals x terms) looked at in one step
_MERGE = 64


@dataclass
class Queries:
    """A bounded slice of the queries: their ids, the distinct terms of each as numbers, and the number of every term."""

    ids: list
    terms: list[np.ndarray]
    number: dict[bytes, int]


@dataclass
class Statistics:
    """Documents with a term (n), terms with repeats (total), and the weight of each term number."""

    n: int
    total: int
    weights: np.ndarray


def _slices(items: DataFrame, max_terms: int) -> Iterator[Queries]:
    """Slices of at most about `max_terms` terms with repeats; a single longer query is a slice of its own."""
    held, size = Queries([], [], {}), 0
    for row in items.toLocalIterator():
        found = dict.fromkeys(words((row.text or "").encode()))
        if not found:
            continue
        if held.ids and size + len(found) > max_terms:
            yield held
            held, size = Queries([], [], {}), 0
        held.ids.append(row.item)
        held.terms.append(np.sort(np.array([held.number.setdefault(w, len(held.number)) for w in found], np.int64)))
        size += len(found)
    if held.ids:
        yield held


def _statistics(texts: DataFrame, number) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms with repeats, documents that hold each term)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, total = number.value, 0, 0
        df = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = words((text or "").encode())
                n += bool(found)
                total += len(found)
                df[[known[w] for w in set(found) if w in known]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], at]), pa.int64()), pa.array(np.concatenate([[n, total], df[at]]), pa.int64())], names=["term", "n"])

    rows = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True))
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(number.value))], np.int64)


def _weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Segment:
    """Posting lists of one segment in flat arrays, ordered by term and document, and their range-maximum table."""

    def __init__(self, ids: list, sizes: list[int], postings: list[tuple[np.ndarray, np.ndarray]], statistics: Statistics):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        self.ids = [ids[i] for i in order]
        self.docs = len(order)
        lengths = [len(postings[i][0]) for i in order]
        doc = np.repeat(np.arange(self.docs, dtype=np.int64), lengths)
        none = np.zeros(0, np.int64)
        term = np.concatenate([none, *(postings[i][0] for i in order)])
        tf = np.concatenate([none, *(postings[i][1] for i in order)])
        size = np.repeat(np.array([sizes[i] for i in order], np.int64), lengths)
        m = 50 + 50 * size * statistics.n // max(1, statistics.total)
        score = statistics.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        by_term = np.argsort(term, kind="stable")
        self.doc, self.score = doc[by_term], score[by_term]
        self.key = term[by_term] * self.docs + self.doc  # place of (term, document), in order
        self.ends = np.append(self.key, np.iinfo(np.int64).max)
        self.best = self._table(int(np.bincount(term).max(initial=0)))

    def _table(self, longest: int) -> np.ndarray:
        """best[j, i]: the place of the largest score among the 2**j places from i on, the first in a tie."""
        size = len(self.score)
        out = np.zeros((max(1, longest.bit_length()), size), np.int32)
        out[0] = np.arange(size)
        for j in range(1, len(out)):
            half = 1 << (j - 1)
            near, far = out[j - 1, : size - half], out[j - 1, half:]
            out[j, : size - half] = np.where(self.score[far] > self.score[near], far, near)
        return out

    def place(self, terms: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """First place in each term's list at or behind a document; rows are documents, columns terms."""
        return self.key.searchsorted(terms[:, None] * self.docs + doc).T  # needles in order, near each other

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest score in [low, high) of a list; -1 where the range is empty."""
        size = high - low
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        one = self.best[level, np.minimum(low, len(self.score) - 1)]
        two = self.best[level, np.maximum(high - (1 << level), 0)]
        return np.where(some, np.where(self.score[two] > self.score[one], two, one), -1)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ranges: the sum of the largest scores, and the document that holds the largest of them."""
        at = self.largest(low, high)
        value = np.where(at >= 0, self.score[at], 0)
        top = value.max(axis=1, initial=0)
        held = np.where((at >= 0) & (value == top[:, None]), self.doc[at], self.docs)
        return value.sum(axis=1), held.min(axis=1, initial=self.docs)

    def search(self, terms: np.ndarray, k: int, best: list[tuple]) -> list[tuple]:
        """The k best of `best` and of this segment, as (-score, id is null, id)."""
        every = np.array([0, self.docs])
        whole = self.place(terms, every)
        terms = terms[whole[0] < whole[1]]
        if not len(terms):
            return best
        whole = self.place(terms, every)
        start, end = np.array([0]), np.array([self.docs])
        bound, split = self.bounds(whole[:1], whole[1:])
        step = max(1, _CELLS // len(terms))
        width = 4
        while True:
            if len(best) >= k:
                open_ = self._open(bound, start, best[k - 1])
                start, end, bound, split = start[open_], end[open_], bound[open_], split[open_]
            if not len(bound):
                return best
            take = np.lexsort((start, -bound))[: min(width, step)] if len(bound) > min(width, step) else np.arange(len(bound))
            width = min(2 * width, 256)
            rest = np.ones(len(bound), bool)
            rest[take] = False
            take = take[np.argsort(start[take])]
            a, b, d = start[take], end[take], split[take]
            at = self.place(terms, d)
            hit = self.ends[at] == terms * self.docs + d[:, None]
            exact = np.where(hit, self.score[np.minimum(at, len(self.score) - 1)], 0).sum(axis=1)
            found = [(-s, self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0) for s, i in zip(exact.tolist(), d.tolist(), strict=True) if s > 0]
            best = sorted([*best, *found])[:k]
            left, right = self.bounds(self.place(terms, a), at), self.bounds(at + hit, self.place(terms, b))
            start, end = np.concatenate([start[rest], a, d + 1]), np.concatenate([end[rest], d, b])
            bound, split = np.concatenate([bound[rest], left[0], right[0]]), np.concatenate([split[rest], left[1], right[1]])
            useful = bound > 0
            start, end, bound, split = start[useful], end[useful], bound[useful], split[useful]

    def _open(self, bound: np.ndarray, start: np.ndarray, last: tuple) -> np.ndarray:
        """Intervals that may hold a document better than the k-th so far; in a tie only those with smaller ids."""
        out = bound > -last[0]
        for i in np.flatnonzero(bound == -last[0]):
            first = self.ids[start[i]]
            out[i] = (first is None, first if first is not None else 0) < last[1:]
        return out


def _searcher(queries, statistics, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = queries.value, queries.value.number
        best: list[list[tuple]] = [[] for _ in asked.ids]
        ids, sizes, postings, held, kind = [], [], [], 0, pa.null()

        def flush() -> None:
            nonlocal ids, sizes, postings, held
            segment = Segment(ids, sizes, postings, statistics.value)
            for i, terms in enumerate(asked.terms):
                best[i] = segment.search(terms, k, best[i])
            ids, sizes, postings, held = [], [], [], 0

        for batch in batches:
            kind = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words((text or "").encode())
                counts = Counter(map(known.get, found))
                counts.pop(None, None)
                if not counts:
                    continue
                ids.append(doc)
                sizes.append(len(found))
                postings.append((np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))))
                held += len(counts)
                if len(ids) >= _SEGMENT_DOCS or held >= _SEGMENT_POSTINGS:
                    flush()
        if ids:
            flush()
        for i, rows in enumerate(best):
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(rows), pa.int64()), pa.array([-r[0] for r in rows], pa.int64()), pa.array([None if r[1] else r[2] for r in rows], kind)],
                    names=["query", "score", "id"])

    return search


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", max_terms: int = 500_000,
) -> DataFrame:
    """(item, rank int, id, score long): the `k` highest-scoring documents of each item, those with a score above 0.

    Terms are runs of ASCII digits and letters (A-Z lower-cased) and of all characters beyond ASCII. Null and empty texts
    have none: such documents are not counted, such items have no rows. Each row of `docs` is a document and each row of
    `items` an item, also where ids repeat. Equal scores go to the smaller id, null ids last. Texts of any length are read
    whole. Items are answered in slices of `max_terms` terms, each in passes of its own. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    kinds = (items.schema[item_col].dataType, docs.schema[id_col].dataType)
    out = None
    for part in _slices(asked, max_terms):
        number, queries = spark.sparkContext.broadcast(part.number), spark.sparkContext.broadcast(part)
        n, total, df = _statistics(texts.select("text"), number)
        statistics = spark.sparkContext.broadcast(Statistics(n, total, np.array([_weight(n, int(x)) for x in df], np.int64)))
        found = texts.mapInArrow(_searcher(queries, statistics, k), schema_of(None, query="long", score="long", id=kinds[1]))
        order = [F.desc("score"), F.asc_nulls_last("id")]
        # tasks meet by groups first, so that no task sees the rows of all tasks
        salted = found.withColumn("salt", F.spark_partition_id() % _MERGE)
        some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(part.ids)), schema_of(None, query="long", item=kinds[0]))
        rows = ranked.join(F.broadcast(names), "query").select("item", "rank", "id", "score")  # names: one row an item of the slice
        rows = stored(rows, "lexical-ranks")
        for held in (number, queries, statistics):
            held.destroy()
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], schema_of(None, item=kinds[0], rank="int", id=kinds[1], score="long"))
    return out
