"""Hand-computed cases of the text expressions."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import replies
from marginalia.functions import text as T
from marginalia.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("r")).first()[0]


def test_clean_text_drops_blank_lines_or_keeps_paragraphs(spark):
    t = "a\n\n b  \nc"
    assert one(spark, T.clean_text(F.col("t")), t=t) == "a\nb\nc"
    assert one(spark, T.clean_text(F.col("t"), keep_paragraphs=True), t="a\r\n\r\n\r\n\r\n b \t x ") == "a\n\nb x"


def test_clean_text_normalises_unicode_and_control_characters(spark):
    assert one(spark, T.clean_text(F.col("t")), t="ﬁne  x\u0007y​") == "fine xy"


@pytest.mark.parametrize("text,lang,want", [("a b c\n", "en", 3), ("你好", "zh", 2), ("", "en", 0), ("  ", "fr", 0)])
def test_count_words(spark, text, lang, want):
    assert one(spark, T.count_words(F.col("t"), lang), t=text) == want


def test_persona_id(spark):
    assert one(spark, T.persona_id(F.col("t")), t="Greg's  Startup!") == "gregs_startup"
    assert one(spark, T.persona_display(F.col("t")), t="my_show") == "My Show"


@pytest.mark.parametrize("name,want", [
    ("Café $5 & more [HD].mp3", "cafe_dollar5_and_more_hd"), ("???.mp3", "transcript"), ("a - b.c.txt", "a_b.c"), ("日本.mp3", "transcript"),
])
def test_slugify(spark, name, want):
    assert one(spark, T.slugify(F.col("t")), t=name) == want


def test_slug_is_cut_without_trailing_underscore(spark):
    assert one(spark, T.slugify(F.col("t"), 3), t="ab cd") == "ab"


@pytest.mark.parametrize("word,want", [("make", 1), ("the", 1), ("beautiful", 3), ("rhythm", 1), ("tsk", 1)])
def test_syllables(spark, word, want):
    assert one(spark, T.syllables(F.col("t")), t=word) == want


@pytest.mark.parametrize("content,want", [
    ("# A heading here\nx", "A heading here"), ("short\nA Proper Title\n", "A Proper Title"), ("ends with dot.\n", "my talk"),
    ("LOUD TITLE!\n", "LOUD TITLE!"), ("#no\nlower case line", "my talk"),
])
def test_title(spark, content, want):
    assert one(spark, T.extract_title(F.lit("my_talk_20240131.txt"), F.col("t")), t=content) == want


def test_remove_phrases_is_literal_and_case_insensitive(spark):
    got = one(spark, T.remove_phrases(F.col("t"), ["Buy (now)", "x.y"]), t="a BUY (NOW)  b xzy\n\n\n\nc \n")
    assert got == "a b xzy\n\nc"


def test_decode_prefers_utf8_then_latin1(spark):
    assert one(spark, files.decode_text(F.col("b")), b=bytearray("é".encode())) == "é"
    assert one(spark, files.decode_text(F.col("b")), b=bytearray(b"\xe9t\xe9")) == "été"


def test_excerpt_preview(spark):
    assert one(spark, T.excerpt_preview(F.col("t"), 3), t="abcdef") == 'FULL CONTENT: "abcdef"'
    assert one(spark, T.excerpt_preview(F.col("t"), 2), t="abcdef") == 'BEGINNING: "ab..."\n[...MIDDLE CONTENT OMITTED...]\nENDING: "...ef"'


@pytest.mark.parametrize("seconds,want", [(5.9, "5s"), (61.0, "1m 1s"), (3725.0, "1h 2m 5s")])
def test_format_time(spark, seconds, want):
    assert one(spark, replies.format_time(F.col("s")), s=seconds) == want


@pytest.mark.parametrize("reply,method,json", [
    ('{"a": 1}', "direct", '{"a": 1}'),
    ('x <json_output>[1]</json_output>', "tag", "[1]"),
    ('```json\n{"a": [1]}\n```', "fence", '{"a": [1]}'),
    ('so {"a": {"b": 2}} or [1]', "bracket", '{"a": {"b": 2}}'),
    ("<json_output>```json\n[2]\n```</json_output>", "fence", "[2]"),
    ('<result>{"a": {"b": {"c": {"d": {"e": [1]}}}}}</result>', "tag", '{"a": {"b": {"c": {"d": {"e": [1]}}}}}'),
    ('<output_block><json_output>{"a": 1}</json_output></output_block>', "tag", '{"a": 1}'),
    ('<output kind="x">{"a": 1}', "tag", '{"a": 1}'),
    ('one [see below] then {"a": "} ] {", "b": {"c": [[[[2]]]]}} and "more', "bracket", '{"a": "} ] {", "b": {"c": [[[[2]]]]}}'),
    ('open { and then {"a": [3]}', "bracket", '{"a": [3]}'),
    ('so {"a": "' + "x" * 50_000 + '"} ok', "bracket", '{"a": "' + "x" * 50_000 + '"}'),
    ("[" * 20_000, "failed", None),
    ("nothing", "failed", None),
    (None, "failed", None),
])
def test_extract_json(spark, reply, method, json):
    df = spark.createDataFrame([(reply,)], "t STRING").select(replies.extract_json(F.col("t")).alias("r"))
    row = df.first()["r"]
    assert (row["method"], row["json"]) == (method, json)


@pytest.mark.parametrize("reply,want", [('{"result": "r", "answer": "a"}', "a"), (" plain ", "plain"), ('{"rag_query": "q"}', "q")])
def test_final_answer(spark, reply, want):
    assert one(spark, replies.final_answer(F.col("t")), t=reply) == want


@pytest.mark.parametrize("bounds", [{}, {"max_names": 2}, {"max_bytes": 100}], ids=["trie", "joined by rows", "joined by bytes"])
def test_names_of_several_words(spark, bounds):
    """Longest name first, no overlaps, several labels, repeats, empty and null texts and names, an empty dictionary."""
    from marginalia.operators import linguistics as L

    names = [("new york", "CITY"), ("new york times", "PAPER"), ("york", "CITY"), ("york", "PERSON"), ("times square", "PLACE"), ("times square", "PLACE"), ("", "X"), (None, "X")]
    texts = [("a", "New York Times square. York new york!"), ("a", "new new york"), ("b", "times square times"), ("b", ""), ("b", None), ("b", "nothing")]
    docs = spark.createDataFrame(texts, "persona_id STRING, content STRING")
    table = spark.createDataFrame(names, "entity STRING, label STRING")
    got = {tuple(r) for r in L.name_counts(docs, table, **bounds).collect()}
    assert got == {("a", "new york times", "PAPER", 1), ("a", "york", "CITY", 1), ("a", "york", "PERSON", 1), ("a", "new york", "CITY", 2), ("b", "times square", "PLACE", 1)}
    assert L.name_counts(docs, table.limit(0), **bounds).count() == 0
    assert {tuple(r) for r in L.top_names(L.name_counts(docs, table, **bounds), top=1).collect()} == {("a", "new york (CITY)", 2, 1), ("b", "times square (PLACE)", 1, 1)}
