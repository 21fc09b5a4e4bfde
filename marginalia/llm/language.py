"""Language identification, word first with backoff to characters.

The model holds log frequencies per language of words and of character n-grams (5 down to 1, with word edges). Nine tenths
of a frequency are the language's own, one tenth is the mean of all languages, so what a language lacks counts against it
alike for small and large languages. A known word is scored as a word. An unseen word is read left to right: at each place
the longest known n-gram is scored, and where none of its length is known a shorter one, each step at a discount.

Terms are known by 64-bit hashes of their code points, held sorted in flat arrays: all words of many texts are hashed, looked
up and scored together, and a worker holds the arrays of the model and one chunk of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import schema_of, slices, stored, without
from marginalia.session import broadcast_if_small

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
_CHUNK = 200_000  # words scored together
_CELLS = 2_000_000  # (words x languages) held at a time
_OWN = 0.9  # share of a language's own frequency
_FAMILIAR = 3  # mean length of n-grams from which on an unseen word looks like the languages learnt


def _mixed(values: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit integers, one for one."""
    with np.errstate(over="ignore"):
        x = values * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@dataclass
class Letters:
    """Code points of many words, each between edge marks, one after the other."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Letters:
        ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
        points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        return cls(points, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)

    def words(self) -> np.ndarray:
        """A hash of each word: the sum of its scrambled (place, letter) pairs."""
        place = np.arange(len(self.points)) - np.repeat(self.starts, self.ends - self.starts)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_mixed(self.points + (place.astype(np.uint64) << np.uint64(32))), self.starts)
        return _mixed(sums)

    def grams(self) -> list[np.ndarray]:
        """grams()[s - 1][i]: hash of the s code points from i on (meaningless where they leave the word)."""
        out, total = [], np.zeros(len(self.points), np.uint64)
        for size in range(1, LONGEST + 1):
            shifted = np.zeros_like(self.points)
            shifted[: len(self.points) - size + 1] = self.points[size - 1 :]
            with np.errstate(over="ignore"):
                total = total + _mixed(shifted + (np.uint64(size) << np.uint64(32)))
            out.append(_mixed(total))
        return out


@dataclass
class Table:
    """Log frequencies of terms by hash: one number for the languages without the term and, side by side, those of the others."""

    hashes: np.ndarray
    base: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(self.hashes.searchsorted(hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def rows(self, at: np.ndarray, n: int) -> np.ndarray:
        """Log frequencies of the terms at `at` in each of `n` languages."""
        out = np.repeat(self.base[at][:, None], n, axis=1)
        size = self.starts[at + 1] - self.starts[at]
        part = np.arange(size.sum()) + np.repeat(self.starts[at] - (np.cumsum(size) - size), size)
        out[np.repeat(np.arange(len(at)), size), self.langs[part]] = self.logs[part]
        return out


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: Table
    floor: float
    discount: float = -0.9

    def unseen(self, letters: Letters, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean score of the longest known n-grams of each chosen word, weighted as one word, and their mean length.

        All words are read in step: each goes on behind the n-gram it has taken.
        """
        hashes, n = letters.grams(), len(self.langs)
        out, sizes, taken = np.zeros((len(which), n)), np.zeros(len(which)), np.zeros(len(which))
        at, live = letters.starts[which], np.arange(len(which))
        while len(live):
            here, left = at[live], letters.ends[which[live]] - at[live]
            size, found = np.zeros(len(live), np.int64), np.full(len(live), -1)
            for length in range(LONGEST, 0, -1):
                open_ = np.flatnonzero((found < 0) & (left >= length))
                found[open_] = self.grams.find(hashes[length - 1][here[open_]])
                size[open_[found[open_] >= 0]] = length
            known = found >= 0
            out[live[known]] += self.grams.rows(found[known], n) + (self.discount * (LONGEST - size[known]))[:, None]
            out[live[~known]] += self.floor
            sizes[live] += size
            taken[live] += 1
            at[live] += np.maximum(1, size - 1)
            live = live[at[live] < letters.ends[which[live]]]
        return out / taken[:, None], sizes / taken

    def score(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each text's words under each language, share of its words that look familiar)."""
        n = len(self.langs)
        logs, familiar = np.zeros((len(texts), n)), np.zeros(len(texts))
        chunk = max(1_000, min(_CHUNK, _CELLS // max(1, n)))
        flat = [w for words in texts for w in words]
        sizes = np.array([len(words) for words in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        for first in range(0, len(flat), chunk):
            part = flat[first : first + chunk]
            number: dict[str, int] = {}
            which = np.fromiter((number.setdefault(w, len(number)) for w in part), np.int64, len(part))
            letters = Letters.of(list(number))
            at = self.words.find(letters.words())
            known, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            rows, seen = np.zeros((len(number), n)), np.ones(len(number))
            rows[known] = self.words.rows(at[known], n)
            rows[rest], mean = self.unseen(letters, rest)
            seen[rest] = mean >= _FAMILIAR
            own = owner[first : first + chunk]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            logs[own[cuts]] += np.add.reduceat(rows[which], cuts)
            familiar[own[cuts]] += np.add.reduceat(seen[which], cuts)
        return logs, familiar / np.maximum(sizes, 1)


def fit(
    docs: DataFrame, per_lang: int = 1_000, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Learn every language from about `per_lang` of its documents, all where there are fewer, with all their terms.

    The documents are those whose hash of id and language is below a bound that the language's count gives; rows that
    repeat both are in or out together. Rows with null language or text are left out, and a language without a letter in
    them cannot be learnt. The sample bounds the model: about 16 bytes a term and 6 for each language that has it.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = known.groupBy(lang_col).count().select(lang_col, (F.lit(float(per_lang)) / F.col("count")).alias("_share"))
    place = F.shiftrightunsigned(F.xxhash64(id_col, lang_col), 1) / float(1 << 63)
    sample = known.select(id_col, lang_col, text_col).join(broadcast_if_small(share), lang_col).filter(place < F.col("_share"))
    counts = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, kind int, term long, n long")
    by_term = stored(counts.groupBy("kind", "term", "lang").agg(F.sum("n").alias("n")), "language-counts")
    rows = by_term.toArrow()
    langs = sorted(set(rows.column("lang").unique().to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([number[x] for x in coded.dictionary.to_pylist()], np.int16)[coded.indices.to_numpy()] if len(rows) else np.zeros(0, np.int16)
    term, n, kinds = rows.column("term").to_numpy().view(np.uint64), rows.column("n").to_numpy(), rows.column("kind").to_numpy()
    words, grams = (_table(term[kinds == kind], lang[kinds == kind], n[kinds == kind], len(langs)) for kind in (0, 1))
    return Model(langs, words, grams, float(grams.base.min(initial=0.0)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of words (kind 0) and of their n-grams (kind 1) by language."""
    seen: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
    for lang, words in seen.items():
        if not words:
            continue
        letters, times = Letters.of(list(words)), np.fromiter(words.values(), np.int64, len(words))
        room = np.repeat(letters.ends, letters.ends - letters.starts) - np.arange(len(letters.points))
        often = np.repeat(times, letters.ends - letters.starts)
        grams = letters.grams()
        inside = [room >= size for size in range(1, LONGEST + 1)]
        for kind, terms, n in ((0, letters.words(), times), (1, np.concatenate([g[i] for g, i in zip(grams, inside, strict=True)]), np.concatenate([often[i] for i in inside]))):
            distinct, back = np.unique(terms, return_inverse=True)
            total = np.bincount(back, weights=n).astype(np.int64)
            for i in range(0, len(distinct), 20_000):
                part = distinct[i : i + 20_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([kind] * len(part), pa.int32()), pa.array(part), pa.array(total[i : i + 20_000])],
                    names=["lang", "kind", "term", "n"])


def _table(terms: np.ndarray, langs: np.ndarray, n: np.ndarray, n_langs: int) -> Table:
    order = np.lexsort((langs, terms))
    terms, langs, n = terms[order], langs[order], n[order]
    if not len(terms):
        return Table(terms, np.zeros(0, np.float32), np.zeros(1, np.int64), langs, np.zeros(0, np.float32))
    firsts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    own = n / np.bincount(langs, weights=n, minlength=n_langs)[langs]
    mean = np.add.reduceat(own, firsts) / n_langs * (1 - _OWN)
    starts = np.append(firsts, len(terms))
    logs = np.log(_OWN * own + np.repeat(mean, np.diff(starts)))
    return Table(terms[firsts], np.log(mean).astype(np.float32), starts, langs, logs.astype(np.float32))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """`docs` plus lang_pred, score (share of the best language among all, 0 to 1) and familiar (share of the words, 0 to 1,
    that were learnt or are made of learnt n-grams of three letters on average).

    `und` with 0 and 0 where the text is null, empty or has no letter, or where nothing was learnt. Ties go to the
    first language by name. Long texts are read whole. Input columns of the three names are replaced.
    """
    docs = without(docs, "lang_pred", "score", "familiar")
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in slices(batch, text_col, 2_000_000):
                yield _tagged(part, model, text_col, columns)

    return docs.mapInArrow(tag, schema_of(docs, lang_pred="string", score="double", familiar="double"))


def _tagged(batch: pa.RecordBatch, model: Model, text_col: str, columns: list[str]) -> pa.RecordBatch:
    texts = [LETTERS.findall((t or "").lower()) for t in batch.column(text_col).to_pylist()]
    if model.langs:
        logs, familiar = model.score(texts)
        best = logs.argmax(axis=1)
        share = 1 / np.exp(np.minimum(logs - logs.max(axis=1, keepdims=True), 0)).sum(axis=1)
    empty = np.array([not (words and model.langs) for words in texts], bool)
    langs = ["und" if none else model.langs[best[i]] for i, none in enumerate(empty.tolist())]
    score, seen = (np.where(empty, 0.0, x) if model.langs else np.zeros(len(texts)) for x in ((share, familiar) if model.langs else (0, 0)))
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in columns), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(seen, pa.float64())],
        names=[*columns, "lang_pred", "score", "familiar"])
