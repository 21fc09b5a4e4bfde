import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_merges_equal_the_library(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinrst éß中😀1!") for _ in range(rng.randrange(1, 40))) for _ in range(3_000)] + ["a" * 30_000, "!" * 5_001]
    assert bpe.read_ranks(spark, PATH) == RANKS
    for w in words:
        assert bpe.merge_word(w.encode(), RANKS) == REFERENCE._encode_single_piece(w)


def test_fast_split_equals_the_pattern():
    rng = random.Random(2)
    fast, slow = bpe.Splitter(public_tokenizers.PATTERN, True), bpe.Splitter(public_tokenizers.PATTERN, False)
    for _ in range(20_000):
        text = "".join(rng.choice("ab'sT19 \t\n\r\x0b\x1c\x85\xa0éÀ×ªº²¼!?_-relvdm 中") for _ in range(rng.randrange(30)))
        assert fast(text) == slow(text)


@pytest.mark.parametrize("most", [{"coverage": 1.0}, {}, {"coverage": 0.3}, {"max_bytes": 0}])
def test_corpus_round_trip(spark, docs, odd, most):
    """With few words sent along, or none, the rest takes the way through the shuffle."""
    for df in (docs.limit(60), odd):
        out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN, **most), RANKS)
        rows = out.select("text", "ids", "n_tokens", "decoded").collect()
        assert len(rows) == df.count()
        for r in rows:
            want = REFERENCE.encode_ordinary(r.text or "")
            assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
            assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(odd.filter(F.lit(False)), RANKS, public_tokenizers.PATTERN, **most).count() == 0


def test_words_that_share_a_hash_are_not_packed():
    packed = bpe.Packed(np.array([5, 7, 5], np.uint64), np.array([1, 2, 1], np.int32), np.array([1, 2, 3, 4], np.uint16))
    assert packed.hashes.tolist() == [7] and packed.ids[packed.starts[0] :][:2].tolist() == [2, 3]


def test_texts_that_move_to_their_ids(spark, odd, monkeypatch):
    """Too much to send to the texts: both sides meet by shuffle."""
    monkeypatch.setattr(bpe, "broadcast_if_small", lambda df, **bounds: df)
    rows = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, coverage=0.3).select("text", "ids").collect()
    assert len(rows) == odd.count()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == REFERENCE.encode_ordinary(r.text or "") for r in rows)


def test_threshold(spark):
    words = spark.createDataFrame([("a", 1, b"1234"), ("b", 3, b"1234"), ("c", 8, b"1234"), ("d", 9, b"12345678")], "word string, n bigint, ids binary")
    assert [bpe._threshold(words, share, 1 << 20) for share in (1.0, 0.95, 0.8, 0.3)] == [2, 2, 8, 8]
    assert [bpe._threshold(words, 1.0, size) for size in (200, 99, 60, 40, 0)] == [2, 2, 4, 16, 16]
    assert bpe._threshold(words.limit(0), 0.98, 1 << 20) == 1 << 59


def test_rare_words_take_the_shuffle(spark, docs):
    """The registered parameters leave words to explode, join and reassemble, at any size of the corpus."""
    words = bpe.stored(bpe.encode_words(bpe.distinct_words(docs, bpe.Splitter(public_tokenizers.PATTERN, True), "text"), spark.sparkContext.broadcast(RANKS)), "w")
    least = bpe._threshold(words, 0.98, 48 << 20)
    kept, total = words.filter(F.col("n") >= least).agg(F.sum("n")).first()[0], words.agg(F.sum("n")).first()[0]
    assert (0.98 <= kept / total < 1 or least == 2) and words.filter(F.col("n") < least).count() > 0


def test_packed_words_are_found_and_others_are_not():
    words = ["a", " the", "é", "x" * 300]
    ids = [np.array(bpe.merge_word(w.encode(), RANKS), "<u2") for w in words]
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64)
    packed = bpe.Packed(hashes, np.array([len(x) for x in ids], np.int32), np.concatenate(ids))
    asked = ["b", *words, "é "]
    assert packed.get(asked) == [None, *[x.astype("<u4").tobytes() for x in ids], None]
    assert packed.lacks(asked) == {"b", "é "}
    empty = bpe.Packed(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint16))
    assert empty.get(["a"]) == [None] and empty.lacks(["a"]) == {"a"} and packed.get([]) == []


def test_words_around_the_length_at_which_the_merge_changes(spark):
    words = [("ab1é漢 \n"[i % 7] * 3 + "the")[: 1 + i % 5] * (n // 3) for i, n in enumerate(range(240, 800, 9))] + ["\n", "\r\n", " ", "<|endoftext|>"]
    rows = spark.createDataFrame([(bytearray(w.encode()), 1) for w in words], "word binary, n long")
    for r in bpe.encode_words(rows, spark.sparkContext.broadcast(RANKS)).collect():
        assert np.frombuffer(r.ids, bpe._kind(RANKS)).tolist() == bpe.merge_word(bytes(r.word), RANKS)
