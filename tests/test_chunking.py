"""Chunkers against hand-computed windows and plain sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import assembly, chunking as C, folds


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "doc_id BIGINT, source STRING, content STRING")


@pytest.mark.parametrize("n,want", [(900, [(0, 500), (400, 900), (800, 900)]), (500, [(0, 500)]), (0, [])])
def test_word_windows(spark, n, want):
    rows = C.word_chunks(docs(spark, " ".join(f"w{i}" for i in range(n)))).orderBy("chunk_index").collect()
    assert [(r.start_word, r.end_word) for r in rows] == want
    assert all(r.total_chunks == len(want) for r in rows)


def test_contained_tail_can_be_dropped(spark):
    rows = C.word_chunks(docs(spark, " ".join(["w"] * 900)), drop_contained_tail=True).collect()
    assert sorted((r.start_word, r.end_word) for r in rows) == [(0, 500), (400, 900)]


def test_chunk_ids_agree_between_runs(spark):
    d = docs(spark, "a b c " * 300)
    ids = lambda: sorted(r.chunk_id for r in C.word_chunks(d, 100, 20).collect())
    assert ids() == ids() and len(set(ids())) == len(ids())


def test_char_windows_end_behind_blanks(spark):
    text = "x" * 95 + " " + "y" * 200
    rows = C.char_chunks(docs(spark, text), 110, 10).orderBy("chunk_index").collect()
    assert rows[0].content == "x" * 95 + " "
    assert rows[1].start_word == rows[0].end_word - 10
    assert rows[-1].end_word == len(text)
    assert all(rows[i + 1].start_word == rows[i].end_word - 10 for i in range(len(rows) - 1))


def test_simple_paragraphs(spark):
    seven = " ".join(f"S{i}." for i in range(7))
    got = docs(spark, seven, "A. B. C.").select(C.simple_paragraphs(F.col("content"))).collect()
    assert got[0][0] == "S0. S1. S2.\n\nS3. S4. S5.\n\nS6." and got[1][0] == "A. B. C."


def books(spark, text):
    return spark.createDataFrame([("b", text)], "book STRING, content STRING")


def test_chapters_by_heading_pattern(spark):
    body = "word " * 12
    text = f"front matter\nChapter 1 Start\n{body}\nChapter 2 *Next*\n{body}\nChapter 3\nshort"
    rows = C.split_books(books(spark, text)).first()["chapters"]
    assert [r["title"] for r in rows] == ["Chapter 1 Start", "Chapter 2 Next"]
    assert rows[0]["content"].startswith("Chapter 1 Start\n\nword")


def test_inline_chapters_and_whole_book(spark):
    inline = "".join(f"CHAPTER {i}: Title {i}. hello " for i in range(1, 5))
    rows = C.split_books(books(spark, inline)).first()["chapters"]
    assert [r["title"] for r in rows] == [f"Chapter {i}: Title {i}" for i in range(1, 5)]
    assert C.split_books(books(spark, "no headings at all")).first()["chapters"][0]["title"] == "b"


def test_large_chapters_are_cut_at_paragraphs(spark):
    rows = spark.createDataFrame([("b", 0, "T", "\n\n".join(["w " * 40] * 5), 200)], "book STRING, _order INT, original_chapter STRING, content STRING, word_count INT")
    parts = C.split_large(rows, 100).orderBy("part").collect()
    assert [(p.title, p.word_count) for p in parts] == [("T (Part 1)", 80), ("T (Part 2)", 80), ("T (Part 3)", 40)]


def plain_pack(counts, limit, max_items=None):
    runs, start, total = [], 0, 0
    for i, c in enumerate(counts):
        if i > start and (total + c > limit or (max_items and i - start >= max_items)):
            runs.append(start)
            start, total = i, 0
        total += c
    return runs + [start]


def test_pack_runs_equals_plain_fold(spark):
    rnd = random.Random(3)
    lists = [[rnd.randint(0, 60) for _ in range(rnd.randint(1, 30))] for _ in range(40)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i INT, c ARRAY<INT>").select("i", folds.pack_runs(F.col("c"), 100).alias("r")).collect()
    for r in rows:
        assert [x["start"] - 1 for x in r["r"]] == plain_pack(lists[r["i"]], 100)


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_greedy_batches_equal_one_sequential_pass(spark, block):
    """One tenant holds most rows; every block size gives the batches of a plain loop."""
    rnd = random.Random(11)
    rows = [(i, "hot" if rnd.random() < 0.8 else f"p{i % 3}", rnd.randint(0, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, persona_id STRING, tok BIGINT")
    got = assembly.greedy_batches(df, ["persona_id"], ["doc_id"], tokens=F.col("tok"), max_items=5, max_tokens=90, block=block).collect()
    assert len(got) == len(rows)
    batch = {r.doc_id: r.batch_start for r in got}
    for p in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == p]
        starts = plain_pack([r[2] for r in mine], 90, 5)
        for at, r in enumerate(mine):
            assert batch[r[0]] == max(s for s in starts if s <= at)


def test_running_total_over_slices(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", i) for i in range(200)], "o BIGINT, k STRING, v BIGINT")
    got = {r.o: r.t for r in assembly.running_total(df, ["k"], ["o"], {"t": F.col("v")}, slice_width=7).collect()}
    for i in range(200):
        assert got[i] == sum(j for j in range(i) if (j % 4 == 0) == (i % 4 == 0))


def test_recent_messages(spark):
    rows = [(1, 0, "system", "s" * 8), (1, 1, "user", "u" * 40), (1, 2, "assistant", "a" * 40), (1, 3, "user", "u" * 40), (1, 4, "assistant", "a" * 400)]
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    turns = lambda n: sorted(r.turn for r in assembly.recent_messages(df, max_tokens=n).collect())
    assert turns(32) == [0, 1, 2, 3]
    assert turns(31) == [0, 3]  # the assistant turn would fit, but a human turn must open


def test_sentences(spark):
    got = docs(spark, "One. Two!  Three?\nFour").select(T.sentences(F.col("content"))).first()[0]
    assert got == ["One.", "Two!", "Three?", "Four"]


@pytest.mark.parametrize("place", [lambda i: i // 1_000, lambda i: i * 10_000_000], ids=["dense", "sparse"])
def test_ranges_hold_equal_shares(spark, place):
    """One scope holds nearly all rows; whether its order values crowd or spread, ranges are of like size."""
    rows = [("hot" if i % 50 else f"k{i}", place(i), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k STRING, at BIGINT, id BIGINT")
    sizes = [r["count"] for r in assembly.ranged(df, ["k"], ["at", "id"], 2_000).groupBy("_slice").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * min(sizes)
    got = {r.id: r.t for r in assembly.running_total(df, ["k"], ["at", "id"], {"t": F.col("id")}, slice_width=2_000).collect()}
    total, want = {}, {}
    for k, _, i in rows:
        want[i] = total.get(k, 0)
        total[k] = want[i] + i
    assert got == want
