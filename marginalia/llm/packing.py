"""Packing of training sequences by lexical retrieval.

Documents are cut into shards as they lie in their splits, bounded in documents and tokens. A task holds one shard at a
time: the token ids of its documents and a BM25 inverted index over them. A window is opened by a seed (what was cut off
at the last window's end, else the first unused document); the index returns the seed's unused neighbours, best first, and
they fill the window one after the other; what runs over its end opens the next window. Where no neighbour is
left, unused documents follow in order. So every window of a shard is full but the last, whose tokens are dealt to
sequences of a power of two, which need no padding either.

No row crosses the network and nothing meets in one task; a very long document is cut over many windows of its task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_CACHE_BYTES = 160_000_000
_TEXT_BYTES = 4_000_000  # of texts that are encoded at once
_SHARD_BITS, _SEQUENCE_BITS = 16, 24  # of a sequence id, below the number of the partition

# White space parts words in every tokenizer of this kind, and so does the end of a word of Latin-1 letters at an ASCII sign; an
# apostrophe may belong to what follows and to what goes before, so it is left alone. A line is (such a word, the rest).
_PIECES = re.compile(r"((?:[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\n!-&(-/:-@\[-`{-~]))?)([^\n]*)\n")
_END = "\x01"  # the end of a word; not a letter, so no word holds it


@lru_cache(maxsize=2)
def _tokenizer(config: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(config)


def read_tokenizer(path: str) -> str:
    """The tokenizer's file, read on the driver; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _byte_names() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow
    from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words:
    """Ids of many words of Latin-1 letters at once, by the tokenizer's own merges in a faster library.

    That library orders merges by rank and knows no word ends, so a word's end is a byte of its own that joins the last
    letter first. `None` in place of this object where the tokenizer is not of that kind.
    """

    def __init__(self, model: dict):
        import tiktoken

        names, suffix, vocab = _byte_names(), model["end_of_word_suffix"], model["vocab"]
        ranks, ids = {}, []

        def add(token: str) -> None:
            ended = token.endswith(suffix)
            body = bytes(names[c] for c in (token.removesuffix(suffix) if ended else token))
            ranks[body + _END.encode() * ended] = len(ids)
            ids.append(vocab[token])

        by_byte = sorted(names, key=names.get)
        for token in [*by_byte, *(c + suffix for c in by_byte)]:
            add(token)
        for merge in model["merges"]:
            add("".join(merge if isinstance(merge, list) else merge.split(" ")))
        if len(ranks) < len(ids):
            raise ValueError("two merges make one token")
        self.encoding = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array(ids, np.int64)
        self.ends = np.array([t.endswith(_END.encode()) for t in ranks])

    @classmethod
    def of(cls, config: str) -> Words | None:
        full = json.loads(config)
        model, normal = full["model"], json.dumps(full["normalizer"])
        usual = model["type"] == "BPE" and model.get("end_of_word_suffix") and "Lowercase" in normal and '"ByteLevel"' in json.dumps(full["pre_tokenizer"])
        plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or full["post_processor"])
        return cls(model) if usual and plain else None

    def __call__(self, words: list[str], kind: np.dtype) -> list[bytes]:
        ranks = self.encoding.encode_to_numpy(_END.join([*words, ""]).lower(), disallowed_special=())
        stops = (np.flatnonzero(self.ends[ranks]) + 1) * kind.itemsize
        packed, starts = self.ids[ranks].astype(kind).tobytes(), [0, *stops[:-1].tolist()]
        return [packed[a:b] for a, b in zip(starts, stops.tolist(), strict=True)]


_words = lru_cache(maxsize=2)(Words.of)


class Encoder:
    """Ids of whole texts: texts are parted at white space, each different part is looked up or encoded once, and the ids are
    gathered by the parts' numbers.

    The tokenizer must drop white space and never join across it, so a text's ids are those of its parts in order. Ids are kept
    in two generations of half of `_CACHE_BYTES`: when the younger is full it replaces the older, and parts met again return
    from that, so frequent ones stay whatever comes between.
    """

    def __init__(self, config: str):
        self.tokenizer, self.words = _tokenizer(config), _words(config)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, words: set[str], others: set[str]) -> dict[str, bytes]:
        """Ids of new pieces; `words` are of Latin-1 letters."""
        if self.words is None:
            words, others = set(), words | others
        words, others = list(words), list(others)
        out = dict(zip(words, self.words(words, self.kind), strict=True)) if words else {}
        encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else []
        out.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(others, encoded, strict=True))
        return out

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, from what is known or encoded now."""
        known, older = self.known, self.older
        out = list(map(known.get, parts))
        late = [p for p, ids in zip(parts, out) if ids is None]
        if not late:
            return out
        new = {p: older[p] for p in late if p in older}
        fresh = [p for p in late if p not in new]
        split = _PIECES.findall("\n".join([*fresh, ""]))
        words, others = {w for w, _ in split if w}, {r for w, r in split if r or not w}
        pieces = words | others
        have = {p: known[p] for p in pieces & known.keys()}
        again = {p: older[p] for p in pieces & older.keys() - have.keys()}
        new.update(again)
        new.update(self._encode(words - have.keys() - again.keys(), others - have.keys() - again.keys()))
        have.update(new)
        new.update((w + r, have[w] + have[r]) for w, r in split if w and r)
        out = [new[p] if ids is None else ids for p, ids in zip(parts, out)]
        size = sum(map(len, new)) + sum(map(len, new.values())) + 160 * len(new)
        if self.held + size > _CACHE_BYTES // 2:
            self.older, self.known, self.held = known, {}, 0
        if size <= _CACHE_BYTES // 2:
            self.known.update(new)
            self.held += size
        return out

    def __call__(self, texts: list[str] | pa.Array, end: int) -> list[np.ndarray]:
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.string()), ""))
        parts = split.flatten().dictionary_encode()
        ids = self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        number = parts.indices.to_numpy()
        n = size[number]
        stops = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[number] - stops + n, n)
        # a text's ids start where its first part does, behind the ends of the texts before
        bounds = np.concatenate([[0], stops])[split.offsets.to_numpy()]
        out = np.full(len(at) + len(texts), end, self.kind)
        out[np.arange(len(at)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = np.frombuffer(b"".join(ids), self.kind)[at]
        bounds += np.arange(len(bounds))
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def _encoder(config: str) -> Encoder:
    """What is known serves the next task of the process."""
    return Encoder(config)


class Index:
    """BM25 inverted index over the distinct token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        length = np.array([len(d) for d in docs], np.int64)
        tokens = np.concatenate(docs)
        size = int(tokens.max()) + 1
        key = np.repeat(np.arange(len(docs)), length) * size + tokens
        key = np.sort(key.astype(np.uint32) if len(docs) * size < 1 << 32 else key)  # shorter numbers sort faster
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key)))
        place, term = np.divmod(key[first], key.dtype.type(size))
        place, term = place.astype(np.int64), term.astype(tokens.dtype)
        each = np.cumsum(np.bincount(place, minlength=len(docs)))
        self.terms = np.split(term, each[:-1])
        df = np.bincount(term)
        # terms of over half the documents tell nothing apart and weigh 0
        idf = np.log(np.maximum((len(docs) - df + 0.5) / (df + 0.5), 1.0))
        kept = np.flatnonzero(idf[term] > 0)
        order = kept[np.argsort(term[kept], kind="stable")]
        place, term, tf = place[order], term[order], tf[order].astype(float)
        self.place = place
        self.score = idf[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[place] / length.mean())))
        df = np.where(idf > 0, df, 0)
        stops = np.cumsum(df)
        self.starts, self.stops = stops - df, stops
        self.docs = len(docs)

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a telling term with `doc`, best first; equal scores in order."""
        terms = self.terms[doc]
        spans = [slice(a, b) for a, b in zip(self.starts[terms].tolist(), self.stops[terms].tolist()) if b > a]
        if not spans:
            return np.zeros(0, np.int64)
        place, score = np.concatenate([self.place[x] for x in spans]), np.concatenate([self.score[x] for x in spans])
        scores = np.bincount(place, weights=score, minlength=self.docs)
        scores[used] = 0
        found = np.flatnonzero(scores > 0)
        return found[np.argsort(-scores[found], kind="stable")]


def _powers(size: int) -> list[int]:
    """Powers of two that add up to `size`, largest first."""
    return [1 << i for i in reversed(range(size.bit_length())) if size >> i & 1]


def pack_shard(docs: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of one shard, sequences numbered from 0."""
    index = Index(docs)
    used = np.zeros(len(docs), bool)
    order, next_free = [], 0

    def follow(seed: int, room: int) -> int:
        """Take the seed's neighbours, then unused documents in order, until `room` is filled; what the last has too much."""
        nonlocal next_free
        for other in index.neighbours(seed, used).tolist() if room > 0 else ():
            if room <= 0:
                break
            used[other] = True
            order.append(other)
            room -= len(docs[other])
        while room > 0 and next_free < len(docs):
            if not used[next_free]:
                used[next_free] = True
                order.append(next_free)
                room -= len(docs[next_free])
            next_free += 1
        return -room

    over = 0  # tokens of the last document that lie behind the last full window
    while True:
        if over == 0:
            while next_free < len(docs) and used[next_free]:
                next_free += 1
            if next_free == len(docs):
                break
            seed = next_free
            used[seed] = True
            order.append(seed)
            over = len(docs[seed])
        room = -over % window
        left = follow(order[-1], room)
        if left < 0:
            break  # the shard is used up
        over = left
    total = sum(len(d) for d in docs)
    sizes = [window] * (total // window) + _powers(total % window)
    out, sequence, offset = [], 0, 0
    for doc in order:
        start = 0
        while start < len(docs[doc]):
            length = min(len(docs[doc]) - start, sizes[sequence] - offset)
            out.append((doc, start, length, sequence, offset))
            start, offset = start + length, offset + length
            if offset == sizes[sequence]:
                sequence, offset = sequence + 1, 0
    return out


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, end_id: int) -> Iterator[tuple]:
    """(id, tokens) of all documents; texts of about `_TEXT_BYTES` are encoded at once, however batches are cut."""
    held, size = [], 0

    def flush() -> Iterator[tuple]:
        ids = [x for part in held for x in part.column("id").to_pylist()]
        texts = pa.concat_arrays([part.column("text") for part in held])
        yield from zip(ids, encoder(texts, end_id), strict=True)

    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + _TEXT_BYTES - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(upto[stop - 1]) - before
            start = stop
            if size >= _TEXT_BYTES or start < batch.num_rows:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def pack(
    docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, *, id_col: str = "doc_id", text_col: str = "text",
    shard_docs: int = 2_048, shard_tokens: int = 2_000_000,
) -> DataFrame:
    """Pieces of packed sequences: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's tokens are those of its whole text and `end_id`; null and empty texts are that id alone. Each row is a
    document, also where ids repeat or are null. Every token lies in exactly one piece. Sequences hold `window`
    tokens; at the end of a shard shorter ones follow whose size is a power of two. Sequence ids are made of partition,
    shard and number within, so they have gaps. Equal neighbours follow in the order of the shard. A shard ends at
    `shard_docs` documents or `shard_tokens` tokens; a longer document is a shard of its own. `tokenizer` is the content
    of the tokenizer's file. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    config = spark.sparkContext.broadcast(tokenizer)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows_id = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(config.value)
        partition, shard = TaskContext.get().partitionId(), 0
        ids, held, size, kind = [], [], 0, to_arrow_type(rows_id)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, held, size, shard
            first = ((partition << _SHARD_BITS) + shard) << _SEQUENCE_BITS
            pieces = pack_shard(held, window)
            for i in range(0, len(pieces), 4_000):
                part = pieces[i : i + 4_000]
                cut = [held[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in part]
                columns = [
                    pa.array([ids[p[0]] for p in part], kind), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array(cut, pa.binary()), pa.array([len(held[p[0]]) for p in part], pa.int64()),
                    pa.array([first + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            ids, held, size, shard = [], [], 0, shard + 1

        for doc, tokens in _encoded(batches, encoder, end_id):
            if held and (len(held) >= shard_docs or size + len(tokens) > shard_tokens):
                yield from flush()
            ids.append(doc)
            held.append(tokens)
            size += len(tokens)
        if held:
            yield from flush()

    packed = rows.mapInArrow(run, f"id {rows_id.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)
