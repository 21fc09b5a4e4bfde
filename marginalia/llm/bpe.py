"""Byte-level BPE over a corpus: every distinct pre-token is encoded once.

1. Tasks count the pre-tokens of their texts; the distinct ones of the whole corpus meet in one aggregation (map
   sides combine, so a word that makes up a third of the corpus is one row per task).
2. Each distinct pre-token is merged once and kept as a row (word, n, ids).
3. Ids are joined back. The most frequent pre-tokens, those that make up `coverage` of all occurrences within
   `max_bytes`, are sent to every task as packed arrays and replaced where the texts lie. Every other pre-token is exploded
   with its position, joined by shuffle on the word, gathered by text and put in place by position.
4. Decoding joins the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import schema_of, slices, stored, without
from marginalia.session import broadcast_if_small

# The same split for texts of Latin-1 characters only; the standard engine reads plain sets faster than properties.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
_FLUSH = 100_000
_BYTES = 1_000_000  # of text looked up together
_LONG = 256  # bytes from which a pre-token is merged by the heap, whose time does not grow with the square


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line `base64 rank`, read on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Splitter:
    """Pre-tokens of a text by `pattern`."""

    def __init__(self, pattern: str, latin: bool):
        self.general = regex.compile(pattern)
        self.latin = latin

    def __call__(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or not _BEYOND_LATIN.search(text)):
            return _LATIN.findall(text)
        return self.general.findall(text)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is merged until none is known.

    A heap of candidate pairs over a linked list keeps very long pre-tokens at n log n.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts at i; 0 once swallowed
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def distinct_words(docs: DataFrame, splitter: Splitter, text_col: str) -> DataFrame:
    """(word binary, n long) of all pre-tokens of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(splitter(text))
            if len(held) >= _FLUSH:
                yield _counts(held)
                held = Counter()
        if held:
            yield _counts(held)

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _kind(ranks: dict[bytes, int]) -> str:
    """Integers of 16 bits where all ids fit, else of 32."""
    return "<u2" if max(ranks.values(), default=0) < 65536 else "<u4"


def encode_words(words: DataFrame, ranks) -> DataFrame:
    """`words` with ids as little-endian integers of `_kind`, and the 64-bit hash of the word.

    The public library merges words of usual length, each as one piece; `merge_word` merges the long ones.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = ranks.value, _kind(ranks.value)
        library = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=table, special_tokens={})
        for batch in batches:
            found = batch.column("word").to_pylist()
            merged = (library.encode_ordinary(w.decode()) if len(w) < _LONG else merge_word(w, table) for w in found)
            ids = [np.array(x, kind).tobytes() for x in merged]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(hashes)], names=["word", "n", "ids", "hash"])

    return words.mapInArrow(encode, "word binary, n long, ids binary, hash long")


class Packed:
    """Ids of many words in four arrays, found by the word's hash. Hashes that two words share are left out.

    About 20 bytes a word: the 64-bit hash, place and number of its ids, and ids of 16 bits where they fit.
    """

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes)
        starts = (np.cumsum(lengths, dtype=np.int64) - lengths)[order]
        hashes = hashes[order]
        lone = np.ones(len(hashes), bool)
        if len(hashes) > 1:
            same = hashes[1:] == hashes[:-1]
            lone[1:] &= ~same
            lone[:-1] &= ~same
        self.hashes, self.starts, self.lengths, self.ids = hashes[lone], starts[lone], lengths[order][lone], ids

    def __len__(self) -> int:
        return len(self.hashes)

    def _find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word's hash, and whether it is here."""
        if not len(self.hashes):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        at = np.minimum(self.hashes.searchsorted(hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def lacks(self, words: list[str]) -> set[str]:
        """The words that are not here."""
        return {words[i] for i in np.flatnonzero(~self._find(words)[1]).tolist()}

    def get(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word as little-endian unsigned 32-bit integers; None for a word that is not here."""
        out: list[bytes | None] = [None] * len(words)
        at, known = self._find(words)
        places = np.flatnonzero(known)
        lengths = self.lengths[at[places]].astype(np.int64) if len(places) else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        first = np.repeat(self.starts[at[places]] - (ends - lengths), lengths) if len(places) else np.zeros(0, np.int64)
        ids = self.ids[first + np.arange(len(first))].astype("<u4").tobytes()
        stop = (4 * ends).tolist()
        for i, low, high in zip(places.tolist(), [0, *stop], stop):
            out[i] = ids[low:high]
        return out


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text_col: str = "text", coverage: float = 0.98, max_bytes: int = 48 << 20,
    latin_pattern: bool = True,
) -> DataFrame:
    """`docs` plus ids (binary, little-endian unsigned 32-bit) and n_tokens (long).

    Null and empty texts have no tokens. Very long texts are encoded whole. Special tokens are ordinary text.
    `latin_pattern` says that `pattern` is the usual one, for which a faster equal split exists. What is sent to the tasks is
    bounded by `max_bytes` whatever the words' lengths; `coverage` and `max_bytes` never change the result. Rows with
    equal texts share one set of joined ids, known by 128 bits of hash. Input columns called ids or n_tokens are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "ids", "n_tokens")
    splitter = Splitter(pattern, latin_pattern)
    table = spark.sparkContext.broadcast(ranks)
    vocabulary = stored(encode_words(distinct_words(docs, splitter, text_col), table), "bpe-words")
    frequent = vocabulary.filter(F.col("n") >= _threshold(vocabulary, coverage, max_bytes))
    packed = spark.sparkContext.broadcast(_pack(frequent.select("hash", "ids"), _kind(ranks)))

    # the rest: (text, position, word) by word, then (text, positions and ids) by text
    key = [F.xxhash64(F.col(text_col)).alias("_bpe_one"), F.xxhash64(F.col(text_col), F.lit(1)).alias("_bpe_two")]

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                rows: list[tuple[int, int, int, bytes]] = []
                split = [splitter(t or "") for t in part.column("text").to_pylist()]
                unknown = packed.value.lacks(list(set().union(*split)))
                if unknown:
                    for one, two, words in zip(part.column("_bpe_one").to_pylist(), part.column("_bpe_two").to_pylist(), split, strict=True):
                        if not unknown.isdisjoint(words):
                            rows += [(one, two, i, w.encode()) for i, w in enumerate(words) if w in unknown]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["_bpe_one", "_bpe_two", "at", "word"])

    exploded = docs.select(*key, F.col(text_col).alias("text")).mapInArrow(missing, "_bpe_one long, _bpe_two long, at int, word binary").distinct()
    found = exploded.join(vocabulary.select("word", "ids"), "word")
    rest = found.groupBy("_bpe_one", "_bpe_two").agg(F.collect_list(F.struct("at", "ids")).alias("rest"))
    joined = lambda part: F.unhex(F.array_join(F.transform("rest", part), ""))
    placed = stored(rest.select(
        "_bpe_one", "_bpe_two", joined(lambda x: F.lpad(F.hex(x["at"]), 8, "0")).alias("_bpe_at"),
        joined(lambda x: F.lpad(F.hex(F.octet_length(x["ids"])), 8, "0")).alias("_bpe_size"), joined(lambda x: F.hex(x["ids"])).alias("_bpe_ids")), "bpe-rest")
    # texts move only where what is joined to them is too large to be sent to where they lie
    small = broadcast_if_small(placed, max_rows=2_000_000, max_bytes=96 << 20)
    whole = docs.select("*", *key).join(small, ["_bpe_one", "_bpe_two"], "left").drop("_bpe_one", "_bpe_two")
    return _assemble(whole, splitter, packed, text_col, _kind(ranks))


def _split(texts: pa.Array, splitter: Splitter, packed: Packed) -> tuple[list[list[str]], dict[str, bytes | None]]:
    """Pre-tokens of each text, and the packed ids of each distinct one."""
    split = [splitter(t or "") for t in texts.to_pylist()]
    words = list(set().union(*split))
    return split, dict(zip(words, packed.get(words), strict=True))


def _threshold(vocabulary: DataFrame, coverage: float, max_bytes: int) -> int:
    """The largest power of two for which words of that count or more make up `coverage` of all occurrences; a larger one
    where they would take more than `max_bytes`, and never 1: words that occur once are joined. One aggregation, one row."""
    powers = [1 << i for i in range(60)]
    taken = F.octet_length("ids") + 20  # hash, place, number of ids, ids
    sums = [F.sum(F.when(F.col("n") >= p, F.col("n"))).alias(f"n{p}") for p in powers]
    sizes = [F.sum(F.when(F.col("n") >= p, taken.cast("bigint"))).alias(f"b{p}") for p in powers]
    row = vocabulary.agg(*sums, *sizes).first()
    total = row["n1"] or 0
    enough = [p for p in powers if (row[f"n{p}"] or 0) >= coverage * total]
    fits = [p for p in powers if (row[f"b{p}"] or 0) <= max_bytes]
    return max(2, max(enough, default=1), min(fits, default=1 << 60))


def _pack(words: DataFrame, kind: str) -> Packed:
    """Tasks pack their words, so the driver receives a few byte strings and never a row per word."""
    width = np.dtype(kind).itemsize

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            if ids:
                lengths = np.fromiter((len(x) // width for x in ids), np.int32, len(ids))
                columns = [batch.column("hash").to_numpy().tobytes(), lengths.tobytes(), b"".join(ids)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["hashes", "lengths", "ids"])

    rows = words.mapInArrow(block, "hashes binary, lengths binary, ids binary").collect()
    joined = lambda name, dtype: np.frombuffer(b"".join(r[name] for r in rows), dtype)
    return Packed(joined("hashes", np.uint64), joined("lengths", np.int32), joined("ids", kind))


def _assemble(docs: DataFrame, splitter: Splitter, packed, text_col: str, kind: str) -> DataFrame:
    """Put the ids of each text's pre-tokens in order; the columns `_bpe_at`, `_bpe_size` and `_bpe_ids` hold places and sizes
    (big-endian, 32 bits) and ids (of `kind`) of those that `packed` lacks."""
    rest = ["_bpe_at", "_bpe_size", "_bpe_ids"]
    wider = 4 // np.dtype(kind).itemsize
    names = [c for c in docs.columns if c not in rest]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, _BYTES):
                out = []
                split, known = _split(part.column(text_col), splitter, packed.value)
                for words, places, sizes, ids in zip(split, *(part.column(c).to_pylist() for c in rest), strict=True):
                    parts, first = list(map(known.__getitem__, words)), 0
                    if places:
                        ids = np.frombuffer(ids, kind).astype("<u4").tobytes()
                        for at, size in zip(np.frombuffer(places, ">u4").tolist(), (np.frombuffer(sizes, ">u4") * wider).tolist(), strict=True):
                            parts[at] = ids[first : first + size]
                            first += size
                    out.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())],
                    names=[*names, "ids", "n_tokens"])

    return docs.mapInArrow(place, schema_of(docs.select(*[F.col(f"`{n}`") for n in names]), ids="binary", n_tokens="long"))


def decode(tokens: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids") -> DataFrame:
    """`tokens` plus decoded (binary): the bytes of each id in order. Null ids decode to nothing; unknown ids raise."""
    tokens = without(tokens, "decoded")
    names = tokens.columns
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    held = tokens.sparkSession.sparkContext.broadcast(table)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            out = [b"".join([known[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return tokens.mapInArrow(join, schema_of(tokens, decoded="binary"))
