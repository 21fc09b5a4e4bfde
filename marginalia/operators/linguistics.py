"""Text statistics per scope (usually the tenant). Long scopes are never gathered: every figure is a sum,
a count per word, or a ranking that is cut on both sides of the shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import fixed
from ..functions import text as T
from ..functions.arrays import let, posexplode_rows
from ..session import broadcast_if_small, cut_lineage, kept_table
from . import ranking, term_counts, tfidf
from .neighbours import joined_words, neighbour_counts
from .phrases import repeated_runs

SCOPE = ("persona_id",)
KEYWORD = r"^[a-z][a-z0-9]*$"


def lower_words(c: Column) -> Column:
    return T.alpha_words(F.lower(c))


def keyword_tokens(c: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case ASCII words that start with a letter, stop words removed."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(T.RUN), F.lit(0))
    return F.filter(runs, lambda w: w.rlike(KEYWORD) & ~w.isin(list(stop_words)))


def keywords(
    docs: DataFrame, scope: Sequence[str] = SCOPE, *, id_col: str = "doc_id", content: str = "content",
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS), max_terms: int = 1000, min_df: int = 2,
    max_df: float = 0.95, top: int = 100, grams: tuple[int, int] = (1, 3),
) -> DataFrame:
    """Mean TF-IDF of 1- to 3-grams: (scope, term, score, rank), score in whole thousandths. A row is a document.

    The words are kept once and counted by number in the tasks (`term_counts`); where the frequent words or the
    vocabulary are too many to be sent there, terms are rows and joined.
    """
    scope = list(scope)
    docs = docs.where(F.col(content).rlike(rf"[^{T.BLANK}]"))
    docs = docs.select(*scope, id_col, content)
    n_table = docs.groupBy(*scope).agg(F.count("*").alias("n_docs"))
    tokens, vocab = keyword_tokens(F.col(content), stop_words), None
    if scope and grams[0] == 1:
        rows = kept_table(joined_words(docs, scope, tokens), "words")
        vocab = term_counts.vocabulary(rows, n_table, scope, grams[1], max_terms, min_df, max_df)
    if vocab is not None:
        vocab = cut_lineage(vocab)
        few = broadcast_if_small(vocab) is not vocab
    else:  # more words than tasks can hold
        few = False
        vocab = cut_lineage(tfidf.vocabulary(docs, tfidf.ngrams(tokens, *grams), max_terms, min_df, max_df, scope))
    if few:
        totals = term_counts.total_weights(rows, vocab, scope, grams[1])
    else:
        w = tfidf.weights(tfidf.term_counts(docs, id_col, tfidf.ngrams(tokens, *grams), broadcast_if_small(vocab), scope), id_col, scope)
        totals = w.groupBy(*scope, "term").agg(F.sum("weight").alias("total"))
    mean = (
        totals.join(n_table, scope)
        .withColumn("mean", ranking.rounded(F.col("total") / F.col("n_docs")))
    )
    ranked = ranking.top_k(mean, scope, [F.desc("mean"), F.asc("term")], top)
    return ranked.select(*scope, "term", F.floor(F.col("mean") * 1000).cast("int").alias("score"), "rank")


def dictionary_entities(docs: DataFrame, dictionary: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content") -> DataFrame:
    """Default entity finder: words found in a dictionary of (entity, label)."""
    rows = docs.select(*scope, F.explode_outer(lower_words(F.col(content))).alias("entity"))
    return rows.join(broadcast_if_small(dictionary), "entity")


def name_counts(
    docs: DataFrame, dictionary: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content", max_names: int = 500_000, max_bytes: int = 32 << 20,
) -> DataFrame:
    """(scope, entity, label, mentions): names of any number of words, given as (entity, label) with single blanks.

    At each word of a text the longest name that starts there is taken and the search goes on behind it. Names with
    several labels count under each; null and empty names or texts match nothing. A dictionary within both bounds becomes a
    trie of words in the tasks, which count before anything is shuffled; a larger one is joined with the word runs.
    """
    scope = list(scope)
    names = dictionary.select("entity", "label").where(F.length("entity") > 0).distinct()
    rows = docs.select(*scope, lower_words(F.col(content)).alias("_w")).where(F.size("_w") > 0)
    size = F.coalesce(F.octet_length("entity") + F.octet_length("label"), F.lit(0)) + 64
    held = names.select(size.alias("b")).limit(max_names + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    found = _names_by_trie(rows, names, scope) if held.n <= max_names and held.b <= max_bytes else _names_by_join(rows, names, scope)
    return found.groupBy(*scope, "entity", "label").agg(F.sum("mentions").alias("mentions"))


def _names_by_trie(rows: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    trie: dict = {}
    for r in names.collect():  # bounded by the caller
        node = trie
        for word in r.entity.split(" "):
            node = node.setdefault(word, {})
        node.setdefault(None, []).append((r.entity, r.label))
    held = rows.sparkSession.sparkContext.broadcast(trie)
    fields = [*rows.select(*scope).schema.fields, *names.schema.fields, ST.StructField("mentions", ST.LongType())]
    schema = ST.StructType(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = held.value
        for batch in batches:
            seen: Counter = Counter()
            keys = zip(*(batch.column(c).to_pylist() for c in scope)) if scope else ((),) * batch.num_rows
            for key, words in zip(keys, batch.column("_w").to_pylist(), strict=True):
                at = 0
                while at < len(words):
                    node, end, labels, stop = top, at, (), at + 1
                    while end < len(words) and (node := node.get(words[end])) is not None:
                        end += 1
                        if None in node:
                            labels, stop = node[None], end
                    for name in labels:
                        seen[(*key, *name)] += 1
                    at = stop
            columns = list(zip(*seen)) or [()] * (len(fields) - 1)
            types = [*(batch.schema.field(c).type for c in scope), pa.string(), pa.string()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(seen.values()), pa.int64())], names=schema.names)

    return rows.mapInArrow(count, schema)


def _names_by_join(rows: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """The same by a shuffle on the word runs; the names found in one text meet again by its row number."""
    rows = cut_lineage(rows).withColumn("_row", F.monotonically_increasing_id())
    names = cut_lineage(names.withColumn("_n", F.size(F.split("entity", " "))))
    sizes = sorted(r[0] for r in names.select("_n").distinct().collect())  # word counts of names: a few numbers

    def cuts(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("_w", i, F.lit(n)), " ").alias("entity")))

    runs = F.concat(*[cuts(n) for n in sizes]) if sizes else F.array().cast("array<struct<at int, entity string>>")
    hits = rows.select(*scope, "_row", runs.alias("_r")).select(*scope, "_row", F.explode("_r").alias("r")).select(*scope, "_row", "r.at", "r.entity")
    labels = names.groupBy("entity", "_n").agg(F.collect_list("label").alias("labels"))
    hits = hits.join(labels, "entity").select(*scope, "_row", F.struct("at", (-F.col("_n")).alias("longest"), "entity", "labels").alias("h"))
    per_text = hits.groupBy(*scope, "_row").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    kind = dict(per_text.dtypes)["hs"]
    start = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("kept"))
    taken = F.aggregate("hs", start, lambda s, h: F.when(
        h["at"] >= s["free"], F.struct((h["at"] - h["longest"]).alias("free"), F.concat(s["kept"], F.array(h)).alias("kept"))).otherwise(s))
    kept = per_text.select(*scope, F.explode(taken["kept"]).alias("h"))
    return kept.select(*scope, "h.entity", F.explode("h.labels").alias("label"), F.lit(1).cast("bigint").alias("mentions"))


def top_names(counts: DataFrame, scope: Sequence[str] = SCOPE, top: int = 50) -> DataFrame:
    """Most frequent names as `text (LABEL)`; numbers and times are not counted."""
    rows = counts.where(~F.col("label").isin(fixed.SKIPPED_ENTITY_LABELS) & (F.length("entity") > 2))
    named = rows.select(*scope, F.concat("entity", F.lit(" ("), "label", F.lit(")")).alias("entity"), "mentions")
    return ranking.top_k(named, list(scope), [F.desc("mentions"), F.asc("entity")], top)


def model_entities(docs: DataFrame, find: Callable[[Column], Column], scope: Sequence[str] = SCOPE, *, content: str = "content") -> DataFrame:
    """Entities of a plugged-in finder returning array<struct<entity,label>>."""
    rows = docs.select(*scope, F.explode_outer(find(F.col(content))).alias("e"))
    return rows.select(*scope, F.lower(T.strip(F.col("e.entity"))).alias("entity"), F.col("e.label").alias("label"))


def entity_counts(found: DataFrame, scope: Sequence[str] = SCOPE, top: int = 50) -> DataFrame:
    """Most frequent entities as `text (LABEL)`; numbers and times are not counted."""
    rows = found.where(
        ~F.col("label").isin(fixed.SKIPPED_ENTITY_LABELS) & (F.length("entity") > 2) & F.col("entity").rlike(r"^\p{L}+$")
    )
    counts = rows.groupBy(*scope, "entity", "label").agg(F.count("*").alias("mentions"))
    named = counts.select(*scope, F.concat("entity", F.lit(" ("), "label", F.lit(")")).alias("entity"), "mentions")
    return ranking.top_k(named, list(scope), [F.desc("mentions"), F.asc("entity")], top)


def content_words(c: Column, stop_words: Sequence[str]) -> Column:
    return F.filter(lower_words(c), lambda w: (F.length(w) > 2) & ~w.isin(list(stop_words)))


def collocations(
    docs: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content",
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS), window: int = 3, min_count: int = 3, min_score: float = 5.0,
    top_pairs: int = 25, top_triples: int = 20, top: int = 50,
) -> DataFrame:
    """Bi- and trigrams of content words by chi-squared: (scope, ngram, kind, frequency, score, rank).

    Neighbours are taken inside a document. Words, and pairs and triples that may be seen `min_count` times, are counted
    by number in the tasks (`neighbours`); what is left behind the shuffle is written once for the joins that follow.
    """
    scope = list(scope)
    counts = neighbour_counts(docs, content_words(F.col(content), stop_words), scope, window, min_count)
    # A triple seen `min_count` times has pairs seen at least as often, so nothing needed is dropped here.
    often = (F.col("n") >= min_count) | (F.col("far") >= min_count)
    counts = cut_lineage(counts.where(F.col("b").isNull() | often))
    is_pair = F.col("b").isNotNull() & F.col("c").isNull()

    def counted(rows: Column, n: str, *keys: str) -> DataFrame:
        return counts.where(rows & (F.col(n) > 0)).select(*scope, *keys, F.col(n).alias("n"))

    singles = counted(F.col("b").isNull(), "n", "a").withColumnRenamed("a", "w")
    near, far = counted(is_pair, "near", "a", "b"), counted(is_pair, "far", "a", "b")
    totals = singles.groupBy(*scope).agg(F.sum("n").alias("n_all"))

    # A word begins at most `steps` pairs wherever it stands, so those of frequent pairs are themselves that frequent.
    steps = max(window, 3) - 1
    needed = singles.where(F.col("n") * steps >= min_count)

    def with_single(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(needed.select(*scope, F.col("w").alias(key), F.col("n").alias(name)), [*scope, key])

    pairs = counted(is_pair & (F.col("n") >= min_count), "n", "a", "b")
    pairs = with_single(with_single(pairs, "a", "n_a"), "b", "n_b").join(totals, scope)
    both = F.col("n") / F.lit(window - 1.0)
    left, right = F.col("n_a") - both, F.col("n_b") - both
    none = F.col("n_all") - both - left - right
    chi2 = F.col("n_all") * F.try_divide(
        F.pow(both * none - left * right, F.lit(2)), (both + left) * (both + right) * (left + none) * (right + none)
    )
    pairs = pairs.select(*scope, F.concat_ws(" ", "a", "b").alias("ngram"), F.lit("bigram").alias("kind"),
                         F.col("n").alias("frequency"), ranking.rounded(chi2).alias("raw"))
    pairs = ranking.top_k(pairs, scope, [F.desc("raw"), F.asc("ngram")], top_pairs)

    tri = counted(F.col("c").isNotNull(), "n", "a", "b", "c")
    tri = tri.join(near.select(*scope, "a", "b", F.col("n").alias("n_ab")), [*scope, "a", "b"])
    tri = tri.join(near.select(*scope, F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n_bc")), [*scope, "b", "c"])
    tri = tri.join(far.select(*scope, "a", F.col("b").alias("c"), F.col("n").alias("n_ac")), [*scope, "a", "c"])
    for key in "abc":
        tri = with_single(tri, key, f"n_{key}")
    tri = tri.join(totals, scope)
    n, na, nb, nc, total = (F.col(x) for x in ("n", "n_a", "n_b", "n_c", "n_all"))
    only = {"ab": F.col("n_ab") - n, "ac": F.col("n_ac") - n, "bc": F.col("n_bc") - n}
    just_a, just_b, just_c = na - n - only["ab"] - only["ac"], nb - n - only["ab"] - only["bc"], nc - n - only["ac"] - only["bc"]
    empty = total - n - only["ab"] - only["ac"] - only["bc"] - just_a - just_b - just_c
    cells = [
        (n, na, nb, nc), (only["ab"], na, nb, total - nc), (only["ac"], na, total - nb, nc), (only["bc"], total - na, nb, nc),
        (just_a, na, total - nb, total - nc), (just_b, total - na, nb, total - nc), (just_c, total - na, total - nb, nc),
        (empty, total - na, total - nb, total - nc),
    ]
    score = F.lit(0.0)
    for seen, x, y, z in cells:
        expected = x.cast("double") * y * z / (total.cast("double") * total)
        score = score + F.coalesce(F.try_divide(F.pow(seen - expected, F.lit(2)), expected), F.lit(0.0))
    tri = tri.select(*scope, F.concat_ws(" ", "a", "b", "c").alias("ngram"), F.lit("trigram").alias("kind"),
                     n.alias("frequency"), ranking.rounded(score).alias("raw"))
    tri = ranking.top_k(tri, scope, [F.desc("raw"), F.asc("ngram")], top_triples)
    all_rows = pairs.drop("rank").unionByName(tri.drop("rank")).where(F.col("raw") >= min_score)
    all_rows = all_rows.withColumn("score", F.round("raw", 2)).drop("raw")
    return ranking.top_k(all_rows, scope, [F.desc("score"), F.asc("ngram")], top)


def readability(docs: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content") -> DataFrame:
    """Sentence, word and syllable totals with reading ease (0 to 100) and grade (at least 0)."""
    per_doc = docs.select(
        *scope,
        F.size(T.sentences(F.col(content))).alias("s"),
        let(T.alpha_words(F.col(content)), lambda ws: F.struct(
            F.size(ws).alias("w"),
            F.aggregate(ws, F.lit(0), lambda a, x: a + F.length(x)).alias("c"),
            F.aggregate(ws, F.lit(0), lambda a, x: a + T.syllables(x)).alias("y"),
        )).alias("m"),
    )
    t = per_doc.groupBy(*scope).agg(
        F.sum("s").alias("total_sentences"), F.sum("m.w").alias("total_words"), F.sum("m.c").alias("letters"), F.sum("m.y").alias("total_syllables")
    ).where((F.col("total_sentences") > 0) & (F.col("total_words") > 0))
    length = F.col("total_words") / F.col("total_sentences")
    per_word = F.col("total_syllables") / F.col("total_words")
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * length - 84.6 * per_word))
    grade = F.greatest(F.lit(0.0), 0.39 * length + 11.8 * per_word - 15.59)
    return t.select(
        *scope, "total_sentences", "total_words", "total_syllables",
        F.round(length, 2).alias("avg_sentence_length"),
        F.round(F.col("letters") / F.col("total_words"), 2).alias("avg_word_length"),
        F.round(per_word, 2).alias("avg_syllables_per_word"),
        F.round(ease, 2).alias("flesch_reading_ease"),
        F.round(grade, 2).alias("flesch_kincaid_grade"),
    )


def histogram_element(counts: DataFrame, scope: Sequence[str], value: str, count: str, out: str) -> DataFrame:
    """Upper median (element n // 2 of the sorted values) from value counts, exact and without a sort of the rows."""
    w = Window.partitionBy(*scope)
    upto = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("_upto", upto).withColumn("_all", F.sum(count).over(w))
    hit = rows.where(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1)
    return hit.groupBy(*scope).agg(F.min(value).alias(out))


def sentence_patterns(docs: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content") -> DataFrame:
    """Question and exclamation shares and the spread of sentence lengths in words."""
    scope = list(scope)
    s = docs.select(*scope, F.explode_outer(T.sentences(F.col(content))).alias("s")).where("s IS NOT NULL")
    s = s.select(*scope, T.count_words(F.col("s")).alias("len"), F.endswith("s", F.lit("?")).alias("q"), F.endswith("s", F.lit("!")).alias("e"))
    counts = s.groupBy(*scope, "len").agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.count_if("e").alias("e"))
    total = F.sum("n")
    agg = counts.groupBy(*scope).agg(
        total.alias("sentences"), (F.sum("q") / total).alias("question_ratio"), (F.sum("e") / total).alias("exclamation_ratio"),
        F.min("len").alias("min_len"), F.max("len").alias("max_len"), (F.sum(F.col("len") * F.col("n")) / total).alias("avg_len"),
    )
    return agg.join(histogram_element(counts, scope, "len", "n", "median_len"), scope)


def punctuation_counts(docs: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content") -> DataFrame:
    marks = {".": "period", ",": "comma", "!": "exclamation", "?": "question", ";": "semicolon", ":": "colon"}
    text = F.col(content)
    return docs.groupBy(*scope).agg(
        *[F.sum(F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))).alias(name) for m, name in marks.items()]
    )


def word_counts(docs: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content", words: Callable[[Column], Column] = lower_words) -> DataFrame:
    rows = docs.select(*scope, F.explode_outer(words(F.col(content))).alias("word")).where("word IS NOT NULL")
    return rows.groupBy(*scope, "word").agg(F.count("*").alias("n"))


def top_words(counts: DataFrame, scope: Sequence[str] = SCOPE, top: int = 20) -> DataFrame:
    return ranking.top_k(counts, list(scope), [F.desc("n"), F.asc("word")], top)


def richness(counts: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    return counts.groupBy(*scope).agg((F.count("*") / F.sum("n")).alias("vocabulary_richness"))


def tag_shares(docs: DataFrame, tags: str, scope: Sequence[str] = SCOPE, top: int = 10) -> DataFrame:
    """Share of the most frequent tags of a supplied tag array."""
    scope = list(scope)
    counts = docs.select(*scope, F.explode(tags).alias("tag")).groupBy(*scope, "tag").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*scope).agg(F.sum("n").alias("total"))
    ranked = ranking.top_k(counts, scope, [F.desc("n"), F.asc("tag")], top)
    return ranked.join(totals, scope).select(*scope, "tag", "rank", (F.col("n") / F.col("total")).alias("share"))


def sentiment(
    docs: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content",
    positive: Sequence[str] = tuple(fixed.POSITIVE_WORDS), negative: Sequence[str] = tuple(fixed.NEGATIVE_WORDS),
) -> DataFrame:
    per_doc = docs.select(*scope, let(lower_words(F.col(content)), lambda ws: F.struct(
        F.size(ws).alias("w"),
        F.size(F.filter(ws, lambda x: x.isin(list(positive)))).alias("p"),
        F.size(F.filter(ws, lambda x: x.isin(list(negative)))).alias("n"),
    )).alias("m"))
    t = per_doc.groupBy(*scope).agg(F.sum("m.w").alias("total_words"), F.sum("m.p").alias("positive"), F.sum("m.n").alias("negative"))
    p, n, w = F.col("positive"), F.col("negative"), F.col("total_words")
    return t.select(
        *scope, "total_words", "positive", "negative",
        F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0)).alias("overall_sentiment"),
        F.coalesce(F.try_divide(p, w), F.lit(0.0)).alias("positive_ratio"),
        F.coalesce(F.try_divide(n, w), F.lit(0.0)).alias("negative_ratio"),
    )


# Openings of catchphrases.
PHRASE_PATTERNS = [
    r"\b(?:listen|look|here's|now|so|but|and)\s+[^.!?]*",
    r"\bthe\s+(?:point|thing|reality|truth)\s+is\b[^.!?]*",
    r"\byou\s+(?:need|have|want|should|must)\s+to\b[^.!?]*",
    r"\blet\s+me\s+(?:tell|show|explain)\b[^.!?]*",
]


def _phrase_ok(p: Column) -> Column:
    starts = p.startswith("the") | p.startswith("and") | p.startswith("or") | p.startswith("but")
    return F.length(p).between(11, 99) & ~starts


def repeated_phrases(
    docs: DataFrame, scope: Sequence[str] = SCOPE, *, content: str = "content", low: int = 3, high: int = 8,
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS), **limits,
) -> DataFrame:
    """Word n-grams seen at least twice inside sentences: (scope, phrase, n).

    Only starts of n-grams that may repeat leave their task (`phrases.repeated_runs`), once for all lengths; the
    count by text is exact. `limits` never change the result.
    """
    scope = list(scope)
    rows = repeated_runs(docs, scope, content=content, low=low, high=high, **limits)

    def grams(ts: Column) -> Column:
        cut = [F.when(F.size(ts) >= n, _cut(ts, n, list(stop_words))(F.lit(1))) for n in range(low, high + 1)]
        return F.filter(F.array(*cut), lambda g: g.isNotNull() & _phrase_ok(g))

    rows = posexplode_rows(rows, [*scope, "_head", "_n"], let(F.split("_run", " "), grams), "_at", "phrase")
    counts = rows.groupBy(*scope, "_head", "phrase").agg(F.sum("_n").alias("n")).where("n >= 2")
    return counts.select(*scope, "phrase", "n")


def _cut(ts: Column, n: int, stop_words: list[str]):
    """Lambda for the n-gram at a start; null where all its words are stop words."""

    def at(i: Column) -> Column:
        part = F.slice(ts, i, F.lit(n))
        return F.when(F.exists(part, lambda w: ~w.isin(stop_words)), F.array_join(part, " "))

    return at


def pattern_phrases(docs: DataFrame, scope: Sequence[str] = SCOPE, *, id_col: str = "doc_id", content: str = "content", per_family: int = 5) -> DataFrame:
    """First matches of each opening family in document order."""
    families = F.array(*[
        F.struct(F.lit(i).alias("family"), F.regexp_extract_all(F.col(content), F.lit("(?i)" + p), F.lit(0)).alias("found"))
        for i, p in enumerate(PHRASE_PATTERNS)
    ])
    rows = docs.select(*scope, id_col, F.explode(families).alias("f"))
    rows = posexplode_rows(rows, [*scope, id_col, F.col("f.family").alias("family")], F.slice("f.found", 1, per_family), "at", "phrase")
    first = ranking.top_k(rows, [*scope, "family"], [F.asc(id_col), F.asc("at")], per_family)
    return first.select(*scope, T.strip(F.col("phrase")).alias("phrase"))


def signature_phrases(docs: DataFrame, scope: Sequence[str] = SCOPE, *, id_col: str = "doc_id", top: int = 20, **kw) -> DataFrame:
    """Repeated n-grams and catchphrase openings, once each, by count and then phrase."""
    scope = list(scope)
    repeated = repeated_phrases(docs, scope, **kw)
    patterned = pattern_phrases(docs, scope, id_col=id_col).where(_phrase_ok(F.col("phrase"))).distinct().withColumn("n", F.lit(1).cast("bigint"))
    both = repeated.unionByName(patterned).groupBy(*scope, "phrase").agg(F.max("n").alias("n"))
    return ranking.top_k(both, scope, [F.desc("n"), F.asc("phrase")], top)


def vocabulary_totals(counts: DataFrame, scope: Sequence[str] = SCOPE, stop_words: Sequence[str] = tuple(fixed.STOP_WORDS)) -> DataFrame:
    """Totals over words of three or more letters, from word counts."""
    c = counts.where(F.length("word") > 2).withColumn("_content", ~F.col("word").isin(list(stop_words)))
    total = F.sum("n")
    return c.groupBy(*scope).agg(
        total.alias("total_words"), F.count("*").alias("unique_words"), (F.count("*") / total).alias("vocabulary_richness"),
        F.coalesce(F.sum(F.when(F.col("_content"), F.col("n"))), F.lit(0)).alias("content_words"),
        F.count_if("_content").alias("unique_content_words"),
        (F.sum(F.length("word") * F.col("n")) / total).alias("avg_length"),
    )


def length_histogram(counts: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    c = counts.where(F.length("word") > 2)
    return c.groupBy(*scope, F.length("word").alias("length")).agg(F.sum("n").alias("words"))


def matching_names(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Names of all rules with a keyword inside the text."""
    return F.array_compact(F.array(*[F.when(T.contains_any(text, needles), F.lit(name)) for name, needles in rules]))


def expertise_domains(keywords_text: Column, entities_text: Column, keyword_rules=fixed.KEYWORD_DOMAINS, entity_rules=fixed.ENTITY_DOMAINS) -> Column:
    found = F.concat(
        matching_names(F.coalesce(keywords_text, F.lit("")), keyword_rules),
        matching_names(F.lower(F.coalesce(entities_text, F.lit(""))), entity_rules),
    )
    return F.array_sort(F.array_distinct(found))


def content_themes(phrases: Column, rules=fixed.PHRASE_THEMES) -> Column:
    """First matching theme of each of the first ten phrases, as a sorted set."""
    themes = F.transform(F.slice(phrases, 1, 10), lambda p: T.first_class(F.lower(p), rules, F.lit(None).cast("string")))
    return F.array_sort(F.array_distinct(F.array_compact(themes)))


def communication_preferences(style: str = "style") -> dict[str, Column]:
    s = lambda f: F.col(f"{style}.{f}")
    often = ["frequent", "constant"]
    return {
        "preferred_format": F.lit("conversational"),
        "uses_storytelling": s("storytelling").isin(often),
        "direct_communication": s("directness").isin(["direct", "very_direct"]),
        "uses_examples": s("use_of_examples").isin(often),
        "humor_level": s("humor"),
        "formality_level": s("formality"),
    }
