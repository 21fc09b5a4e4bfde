"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton is built once per slice of items (at most `max_words` item words, so what is sent to the tasks is
bounded) and training texts stream through it word by word. After each word it knows the longest suffix of the
text that stands in some item; wherever that length reaches the window, the words of the suffix are hit. Further
slices run in the same job over the same texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import schema_of, utf8, without

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of words stay, A-Z are lower-cased, every other byte parts words.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII digits and letters and of all characters beyond ASCII."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """All substrings of the added word sequences; each state knows which items hold its strings."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[set] = [set()]  # whose windows end in the state
        self.short: list[dict[int, set]] = [{}]  # whole shorter items that end in the state, by length
        self.least: list[int] = []  # length of the shortest such item in the state or a suffix of it

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.short.append({})
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A copy of state `q` for the strings that end `p` + word."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def add(self, sequence: list[bytes]) -> None:
        state = 0
        for word in sequence:
            state = self._extend(state, word)

    def finish(self, sequences: Iterable[tuple[object, list[bytes]]]) -> SuffixAutomaton:
        """Second pass, once all states stand: which items have which windows."""
        for item, sequence in sequences:
            size = min(self.window, len(sequence))
            state = held = 0
            for word in sequence:
                state, held = self.next[state][word], held + 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                held = min(held, self.length[state])
                if held >= size == self.window:
                    self.items[state].add(item)
            if 0 < len(sequence) < self.window:
                self.short[state].setdefault(len(sequence), set()).add(item)
        self.least = [self.window] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.least[state] = min([self.window, self.least[self.link[state]], *self.short[state]])
        return self

    def spans(self, text: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged [start, end) spans of hit words, and the items whose windows occur."""
        moves, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        state = held = 0
        out: list[list[int]] = []
        found: set = set()
        for i, word in enumerate(text):
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                held = length[state]
                to = moves[state].get(word)
            if to is None:
                held = 0
                continue
            state = to
            held += 1
            if held < least[state]:
                continue
            reach = held if held >= window else 0
            at = state  # on to the state of the last `window` words, and to the shorter whole items
            while at > 0:
                if held >= window > length[link[at]]:
                    if window <= length[at]:
                        found |= self.items[at]
                for size, items in self.short[at].items():
                    if size <= held:
                        found |= items
                        reach = max(reach, size)
                at = link[at]
            if reach:
                start = i + 1 - reach
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append([start, i + 1])
        return out, found


def build(items: list[tuple[object, bytes]], window: int) -> SuffixAutomaton:
    """Automaton of (item id, text). Items without words are left out."""
    sequences = [(item, words(text)) for item, text in items]
    out = SuffixAutomaton(window)
    for _, sequence in sequences:
        out.add(sequence)
    return out.finish(sequences)


def _sliced(items: Iterable, max_words: int) -> Iterator[list[tuple[object, bytes]]]:
    held, size = [], 0
    for row in items:
        text = bytes(row.body)
        n = len(words(text))
        if held and size + n > max_words:
            yield held
            held, size = [], 0
        held.append((row.item, text))
        size += n
    if held:
        yield held


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, *, text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", max_words: int = 2_000_000,
) -> DataFrame:
    """`docs` plus n_words (long), spans (array of word ranges [start, end) that are hit) and items (array of string).

    A window is `window` consecutive words of an item; a shorter item with words is one window. Null or empty texts
    and items have no words. Repeated items count by their id; an item with a null id marks words but is not listed.
    Texts of any length stream through; ties cannot arise. Input columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    out = without(docs, "n_words", "spans", "items")
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), utf8(item_text).alias("body"))
    kept = out.columns
    schema = schema_of(out, n_words="long", spans="array<struct<start:int,end:int>>", items="array<string>")
    first = True
    for part in _sliced(rows.toLocalIterator(), max_words):
        automaton = spark.sparkContext.broadcast(build(part, window))
        out = out.mapInArrow(_marker(automaton, kept, text_col, first), schema)
        first = False
    if first:  # no items
        out = out.mapInArrow(_marker(spark.sparkContext.broadcast(build([], window)), kept, text_col, True), schema)
    return out


def _marker(automaton, kept: list[str], text_col: str, first: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, spans, items = [], [], []
            before = [([], [])] * batch.num_rows if first else list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True))
            for text, (old_spans, old_items) in zip(batch.column(text_col).to_pylist(), before, strict=True):
                sequence = words((text or "").encode())
                new, found = automaton.value.spans(sequence)
                totals.append(len(sequence))
                spans.append([{"start": a, "end": b} for a, b in merge([*([s["start"], s["end"]] for s in old_spans), *new])])
                items.append(sorted({*old_items, *(x for x in found if x is not None)}))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                names=[*kept, "n_words", "spans", "items"])

    return mark


def merge(spans: list[list[int]]) -> list[list[int]]:
    """Union of ranges, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def hits(spans: str = "spans"):
    """Number of hit words."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, *, text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", max_words: int = 2_000_000,
) -> DataFrame:
    """`docs` with every hit span cut out of its text; documents with more than `max_coverage` of their words hit go.

    Where cutting brings words together that form a new window, that is cut as well. Clean documents come back
    byte for byte. Edge cases are those of `mark_contamination`.
    """
    columns = docs.columns
    out = docs
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), utf8(item_text).alias("body"))
    parts = [docs.sparkSession.sparkContext.broadcast(build(p, window)) for p in _sliced(rows.toLocalIterator(), max_words)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for text in batch.column(text_col).to_pylist():
                body = (text or "").encode()
                clean, share = _cut(body, [p.value for p in parts])
                keep.append(share <= max_coverage)
                texts.append(text if clean is body else clean.decode())
            columns_out = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays(columns_out, names=columns).filter(pa.array(keep))

    return out.mapInArrow(cut, docs.schema) if parts else out


def _cut(body: bytes, automata: list[SuffixAutomaton]) -> tuple[bytes, float]:
    """Text without hit spans, and the share of the original's words that were cut."""
    total = removed = 0
    while True:
        sequence = words(body)
        total = total or len(sequence)
        spans = merge([s for a in automata for s in a.spans(sequence)[0]])
        if not spans:
            return body, removed / total if total else 0.0
        removed += sum(b - a for a, b in spans)
        at = [m.span() for m in WORD.finditer(body.lower())]
        pieces, last = [], 0
        for a, b in spans:
            pieces.append(body[last : at[a][0]])
            last = at[b - 1][1]
        body = b"".join([*pieces, body[last:]])
