import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import packing
from marginalia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
CONFIG = packing.read_tokenizer(PATH)


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(pieces, window):
    """Pieces (row, start, length, sequence, offset, total): each token once, sequences gapless and without padding."""
    by_doc, by_sequence = {}, {}
    for row, start, length, sequence, offset, total in pieces:
        assert length > 0
        by_doc.setdefault((row, total), []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for (_, total), spans in by_doc.items():
        assert sum(n for _, n in spans) == total * (sum(1 for s, _ in spans if s == 0))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_query_equals_the_library(spark, docs):
    out = QUERIES["op11_lexical_packing"](spark, SF)
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    for r in rows:
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
    check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset, r.doc_tokens) for r in rows], 4096)
    assert {r.doc_id for r in rows} == set(ids)


ODD = ["a<|endoftext|>b <|startoftext|>", "don't we'll x's.", "İstanbul ΣΑΣ Οδυσσεύς ﬁ ½ ²", "é a\x1cb\x85c\xa0d e f", "中文 日本語、テスト。",
       "A.b,c;d word, ́x .́ .x̧", "😀😀 <|endoftext|>.", "\x00 \x7f \x01a\x01", "ab)c d) e!̈", "Å̊ q̣̇ ª º µ ÿ×÷", "", " \n\t", "ÀÉÎ," * 50]


def test_pieces_of_odd_texts():
    assert packing.Words.of(CONFIG) is not None
    encoder = packing.Encoder(CONFIG)
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in ODD]
    assert [x.tolist() for x in encoder(ODD, 2)] == want
    slow = packing.Encoder(CONFIG)
    slow.words = None  # a tokenizer of another kind
    assert [x.tolist() for x in slow(ODD, 2)] == want


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_BYTES", 3_000)
    encoder, tokenizer = packing.Encoder(CONFIG), Tokenizer.from_file(PATH)
    for i in range(20):
        texts = [f"alpha{i} Beta gamma {'x' * i}, müde" for i in range(i, i + 3)]
        assert [x.tolist() for x in encoder(texts, 2)] == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert len(encoder.known) < 60


def brute_scores(docs, seed, k1=1.2, b=0.75):
    n, mean = len(docs), np.mean([len(d) for d in docs])
    out = []
    for d in docs:
        score = 0.0
        for t in set(docs[seed].tolist()):
            df, tf = sum(t in x for x in docs), int((d == t).sum())
            idf = max(0.0, np.log((n - df + 0.5) / (df + 0.5)))
            score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
        out.append(score)
    return np.array(out)


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_equal_brute_force(seed):
    random = np.random.default_rng(seed)
    docs = [random.zipf(1.4, random.integers(1, 60)).clip(max=200).astype("<u2") for _ in range(30)]
    index, used = packing.Index(docs), random.random(30) < 0.3
    for doc in range(30):
        scores = brute_scores(docs, doc)
        found = index.neighbours(doc, used).tolist()
        assert set(found) == {i for i in range(30) if scores[i] > 0 and not used[i]}
        assert np.allclose(scores[found], sorted(scores[found], reverse=True))


@pytest.mark.parametrize("seed", range(6))
def test_shards_of_all_sizes(seed):
    random = np.random.default_rng(seed)
    docs = [random.integers(3, 90, random.choice([1, 2, 7, 64, 65, 200, 700])).astype("<u2") for _ in range(random.integers(1, 25))]
    pieces = packing.pack_shard(docs, 64)
    check_pieces([(d, s, n, q, o, len(docs[d])) for d, s, n, q, o in pieces], 64)
    assert {p[0] for p in pieces} == set(range(len(docs)))


def test_window_is_filled_by_neighbours():
    """Three subjects, shuffled: the seed's window takes the other texts of its subject first."""
    docs = [np.array([100 * (i % 3) + j for j in range(16)], "<u2") for i in range(12)]
    first = [p[0] % 3 for p in packing.pack_shard(docs, 64) if p[3] == 0]
    assert first == [0, 0, 0, 0]


def test_odd_rows(spark, odd):
    out = packing.pack(odd, CONFIG, window=64, shard_docs=3, shard_tokens=500)
    rows = out.collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, plain_ids(r.text))
    for r in rows:
        assert bytes(r.ids) == np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
    check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset, r.doc_tokens) for r in rows], 64)
    assert sum(r.length for r in rows) == sum(len(plain_ids(r.text)) for r in odd.collect())
    assert packing.pack(odd.filter(F.lit(False)), CONFIG).count() == 0


SIGNS = ["word$$$ a-b x_y abc123 l'été-d'or it's% (see)", "x≠y a≮b c≯", "a|b <|endoftext|>word <|endoftext|", "naïve\\path ÿ~ ß` Ä[1]{2}",
         "don't-we'll's O'Neil,'s 'tis' x' 'x", "  a\x0bb\x0cc \r\n ", None]


def test_words_end_at_ascii_signs():
    encoder, tokenizer = packing.Encoder(CONFIG), Tokenizer.from_file(PATH)
    odd = [f"wörd{chr(i)}{chr(j)}x" for i in range(33, 127) for j in (33, 39, 44, 0x301, 0x338)]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in [*SIGNS, *odd]]
    assert [x.tolist() for x in encoder([*SIGNS, *odd], 2)] == want
    assert [x.tolist() for x in encoder([*SIGNS, *odd], 2)] == want  # from what is known
    assert encoder([], 2) == []


def test_frequent_parts_are_encoded_once(monkeypatch):
    """Parts met again and again stay known, also where rare ones fill the cache in between, and for the next task."""
    monkeypatch.setattr(packing, "_CACHE_BYTES", 8_000)
    encoder, seen = packing.Encoder(CONFIG), []
    whole = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda words, others: seen.extend(words | others) or whole(words, others))
    for i in range(60):
        texts = ["common often"] if i % 2 else [f"rare{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}{c}" for c in "uvwxyz"]
        encoder(texts, 2)
        assert len(encoder.known) + len(encoder.older) < 80
    assert seen.count("common") == seen.count("often") == 1
    assert packing._encoder(CONFIG) is packing._encoder(CONFIG)
