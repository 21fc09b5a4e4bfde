"""Text expressions: cleaning, words, sentences, titles, slugs. Columns in, columns out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

# What the reference language's `str.split()` treats as blank.
BLANK = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
TOKEN = r"[\p{L}\p{N}_]{2,}"
RUN = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (`trim` removes spaces only)."""
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(c, F.lit(rf"[^{BLANK}]+"), F.lit(0))


def count_words(c: Column, lang: Column | str = "en") -> Column:
    """Characters for `zh`, else white-space words; null and empty give 0."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.coalesce(
        F.when(lang == "zh", F.length(c)).otherwise(F.regexp_count(c, F.lit(rf"[^{BLANK}]+"))),
        F.lit(0),
    )


def tokenize(c: Column, lang: Column | str = "en") -> Column:
    """Characters for `zh` (plug a segmenter in for words), else white-space tokens."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.coalesce(F.when(lang == "zh", chars).otherwise(words(c)), F.array().cast("array<string>"))


def search_tokens(c: Column) -> Column:
    """Lower-cased index terms of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def alpha_words(c: Column) -> Column:
    """Runs of word characters that are letters only, case kept."""
    return F.filter(F.regexp_extract_all(c, F.lit(RUN), F.lit(0)), lambda w: w.rlike(r"^\p{L}+$"))


def sentences(c: Column) -> Column:
    """Split behind `.`, `!` or `?` followed by white space; stripped, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _ascii_fold(s: pd.Series) -> pd.Series:
    return s.map(
        lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    )


def nfkc(c: Column) -> Column:
    """NFKC; only values with a non-ASCII character are sent to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def ascii_fold(c: Column) -> Column:
    """NFKD and drop what is not ASCII; ASCII values stay in the JVM."""
    return F.coalesce(_ascii_fold(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def clean_text(c: Column, keep_paragraphs: bool = False) -> Column:
    """Normalise a loaded text.

    Lines are stripped and runs of blanks become one space. Blank lines vanish unless
    `keep_paragraphs`, which keeps at most one of them between paragraphs.
    """
    t = nfkc(c)
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    if keep_paragraphs:
        edge = r"[^\S\n]"
        t = F.regexp_replace(t, rf"(?m){edge}+$|^{edge}+", "")
        t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    else:
        t = F.regexp_replace(t, rf"(?md)^[{BLANK}]+", "")
        t = F.regexp_replace(t, rf"(?md)[{BLANK}]+$", "")
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\t\r ]]", "")
    return F.when(c.isNull(), F.lit("")).otherwise(strip(t))


def prepare_content(c: Column, lang: Column | str = "en") -> Column:
    """Text as the chunkers want it: `zh` keeps lines, others become one line."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.when(lang == "zh", strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))).otherwise(
        strip(F.regexp_replace(c, rf"[{BLANK}]+", " "))
    )


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]*$", "")


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^./]*)$", 1))


def stem_title(file_name: Column) -> Column:
    t = F.regexp_replace(file_stem(file_name), r"[_-]+", " ")
    t = F.regexp_replace(t, r"\d{8}", "")
    return F.trim(F.regexp_replace(t, rf"[{BLANK}]+", " "))


def extract_title(file_name: Column, content: Column) -> Column:
    """First heading-like line among the first ten, else the tidied file stem."""

    def candidate(line: Column) -> Column:
        heading = strip(F.regexp_replace(line, r"^#+", ""))
        shouting = (line == F.upper(line)) & (line != F.lower(line))
        spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
        plain = (
            F.length(line).between(6, 99)
            & ~line.endswith(".")
            & (shouting | ((spaces < 10) & line.rlike(r"^\p{Lu}")))
        )
        return F.when(
            line.startswith("#"), F.when(F.length(heading).between(6, 99), heading)
        ).otherwise(F.when(plain, line))

    lines = F.slice(F.split(content, "\n"), 1, 10)
    found = F.filter(F.transform(F.transform(lines, strip), candidate), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), stem_title(file_name))


def remove_phrases(c: Column, phrases: list[str]) -> Column:
    """Delete phrases in any case and tidy the white space left behind."""
    t = c
    for phrase in phrases:
        t = F.regexp_replace(t, r"(?iu)\Q" + phrase.replace(r"\E", r"\E\\E\Q") + r"\E", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?md)[ \t]+$", "")
    t = F.regexp_replace(t, r" {2,}", " ")
    return strip(t)


def slugify(name: Column, max_length: int = 100) -> Column:
    """ASCII, lower-case, underscore-separated file slug."""
    t = F.lower(ascii_fold(F.regexp_replace(name, r"\.[^.]*$", "")))
    for symbol, word in fixed.SLUG_WORDS.items():
        t = F.replace(t, F.lit(symbol), F.lit(word))
    t = F.translate(t, fixed.SLUG_UNDERSCORED, "_" * len(fixed.SLUG_UNDERSCORED))
    t = F.regexp_replace(t, r"[\s\-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, r"_+", "_"), r"^_+|_+$", "")
    t = F.when(t == "", F.lit("transcript")).otherwise(t)
    return F.when(F.length(t) > max_length, F.regexp_replace(F.left(t, F.lit(max_length)), r"_+$", "")).otherwise(t)


def persona_id(name: Column) -> Column:
    t = F.regexp_replace(strip(F.lower(name)), rf"[{BLANK}]+", "_")
    t = F.regexp_replace(t, r"[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(t, r"_+", "_"), r"^_+|_+$", "")


def lookup(key: Column, mapping: dict[str, str]) -> Column:
    """Value of a small literal map, null where the key is missing."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def persona_slug(pid: Column, known: dict[str, str] | None = None) -> Column:
    return F.coalesce(lookup(pid, known or {}), F.replace(pid, F.lit("_"), F.lit("-")))


def persona_display(pid: Column, known: dict[str, str] | None = None) -> Column:
    return F.coalesce(lookup(pid, known or {}), F.initcap(F.replace(pid, F.lit("_"), F.lit(" "))))


def split_delimited(c: Column, delimiter: str) -> Column:
    """Delimited text to an array; items trimmed, blanks dropped, null to an empty array."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\Q" + delimiter + r"\E")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def numbered(items: Column, empty: str) -> Column:
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.array_join(lines, "\n"))


def bulleted(items: Column, empty: str) -> Column:
    lines = F.transform(items, lambda x: F.concat(F.lit("• "), x))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.array_join(lines, "\n"))


def comma_list(items: Column, empty: str) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.array_join(items, ", "))


def confidence_level(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "Very High").when(score >= 0.8, "High")
        .when(score >= 0.7, "Medium").when(score >= 0.6, "Low").otherwise("Very Low")
    )


def excerpt_preview(c: Column, max_chars: int = 300) -> Column:
    head, tail = strip(F.left(c, F.lit(max_chars))), strip(F.right(c, F.lit(max_chars)))
    whole = F.concat(F.lit('FULL CONTENT: "'), strip(c), F.lit('"'))
    cut = F.concat(
        F.lit('BEGINNING: "'), head, F.lit('..."\n[...MIDDLE CONTENT OMITTED...]\nENDING: "...'), tail, F.lit('"')
    )
    return F.when(F.length(c) <= 2 * max_chars, whole).otherwise(cut)


def contains_any(c: Column, needles: list[str]) -> Column:
    """True where any of a few literal strings occurs."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(c, F.lit(needle))
    return hit


def first_class(c: Column, rules: list[tuple[str, list[str]]], default: Column | str) -> Column:
    """Name of the first rule with a keyword inside `c`."""
    out = None
    for name, needles in rules:
        hit = contains_any(c, needles)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def count_contained(c: Column, needles: list[str]) -> Column:
    total = F.lit(0)
    for needle in needles:
        total = total + F.contains(c, F.lit(needle)).cast("int")
    return total


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e, at least one."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - (w.endswith("e") & (groups > 1)).cast("int"))


def meaningful_words(c: Column) -> Column:
    """Alphanumeric words over two characters that are neither function words nor numbers."""
    stop = F.array(*[F.lit(w) for w in fixed.KEYWORD_STOP_WORDS])
    cleaned = F.transform(words(F.lower(F.coalesce(c, F.lit("")))), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.filter(
        cleaned, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w) & ~w.rlike(r"^\p{N}+$")
    )
