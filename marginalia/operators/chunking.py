"""Chunkers: one document row in, many chunk rows out, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.arrays import let, posexplode_rows
from . import folds


def _window_starts(n: Column, size: int, step: int, drop_contained_tail: bool) -> Column:
    last = F.greatest(n - size + step - 1, F.lit(0)) if drop_contained_tail else n - 1
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last.cast("int"), F.lit(step)))


def _explode_spans(docs: DataFrame, spans: str, content: str, source: str) -> DataFrame:
    """Rows from an array column of (content, start, stop), plus the parent's other columns."""
    parents = [c for c in docs.columns if c not in (spans, content)]
    out = posexplode_rows(docs, [*parents, F.size(spans).alias("total_chunks")], spans, "chunk_index", "_span")
    out = out.select(
        *[F.col(c) for c in parents if c != source],
        F.col(source).alias("parent_source"),
        F.concat(F.col(source), F.lit("#chunk_"), F.col("chunk_index").cast("string")).alias("source"),
        F.sha2(F.concat_ws("#", source, F.col("chunk_index").cast("string")), 256).alias("chunk_id"),
        "chunk_index",
        "total_chunks",
        F.col("_span.start").alias("start_word"),
        F.col("_span.stop").alias("end_word"),
        F.col("_span.content").alias("content"),
        F.lit(True).alias("is_chunk"),
    )
    return out


def _with_counts(chunks: DataFrame, lang: Column) -> DataFrame:
    return chunks.withColumns(
        {"word_count": T.count_words(F.col("content"), lang), "char_count": F.length("content")}
    )


def word_chunks(
    docs: DataFrame,
    size: int = 500,
    overlap: int = 100,
    *,
    content: str = "content",
    source: str = "source",
    drop_contained_tail: bool = False,
) -> DataFrame:
    """Overlapping word windows; empty documents give no row.

    Windows are cut inside the row and only then exploded, so the word array is never copied per chunk.
    """
    step = max(size - overlap, 1)
    n = F.size("_words")
    starts = _window_starts(n, size, step, drop_contained_tail)
    spans = F.transform(
        starts,
        lambda s: F.struct(
            F.array_join(F.slice("_words", s + 1, F.lit(size)), " ").alias("content"),
            s.alias("start"),
            F.least(s + size, n).alias("stop"),
        ),
    )
    rows = docs.where(F.col(content).rlike(rf"[^{T.BLANK}]")).withColumn("_words", T.words(F.col(content)))
    rows = rows.withColumn("_spans", spans)
    out = _explode_spans(rows.drop("_words"), "_spans", content, source)
    return out.withColumns(
        {"word_count": F.col("end_word") - F.col("start_word"), "char_count": F.length("content")}
    )


def split_documents(docs: DataFrame, size: int = 500, overlap: int = 100, **kw) -> DataFrame:
    """Loader-side split: short documents keep their source and are not marked as chunks; language is kept."""
    out = word_chunks(docs, size, overlap, **kw)
    whole = F.col("total_chunks") == 1
    return out.withColumns(
        {
            "source": F.when(whole, F.col("parent_source")).otherwise(F.col("source")),
            "is_chunk": ~whole,
        }
    )


def segment_chunks(
    docs: DataFrame, segments: str, size: int = 500, overlap: int = 100, *,
    content: str = "content", source: str = "source",
) -> DataFrame:
    """Windows over a segmenter's word array (`segments`); stops once the end is reached."""
    target, lap = max(size // 2, 50), max(overlap // 2, 10)
    step = target - lap
    if step <= 0:
        step = max(target - max(1, lap // 2), 1)
    n = F.size(segments)
    single = (F.length(content) <= size) | (n <= target)
    count = F.lit(1) + F.ceil((n - target) / F.lit(step))
    starts = F.when(single, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), ((count - 1) * step).cast("int"), F.lit(step))
    )
    spans = F.transform(
        starts,
        lambda s: F.struct(
            F.when(single, F.col(content))
            .otherwise(F.array_join(F.slice(segments, s + 1, F.lit(target)), "")).alias("content"),
            s.alias("start"),
            F.when(single, n).otherwise(F.least(s + target, n)).alias("stop"),
        ),
    )
    rows = docs.where(F.length(content) > 0).withColumn("_spans", spans).drop(segments)
    return _with_counts(_explode_spans(rows, "_spans", content, source), F.lit("zh"))


def char_chunks(
    docs: DataFrame, size: int = 500, overlap: int = 100, *, content: str = "content", source: str = "source"
) -> DataFrame:
    """Character windows that prefer to end behind a blank; no limit on their number."""
    spans = F.transform(
        "_runs",
        lambda r: F.struct(
            F.substring(F.col(content), r["start"], r["len"]).alias("content"),
            (r["start"] - 1).alias("start"),
            (r["start"] - 1 + r["len"]).alias("stop"),
        ),
    )
    rows = docs.where(F.length(content) > 0).withColumn("_runs", folds.char_windows(F.col(content), size, overlap))
    rows = rows.withColumn("_spans", spans).drop("_runs")
    return _with_counts(_explode_spans(rows, "_spans", content, source), F.lit("zh"))


def fixed_char_chunks(
    docs: DataFrame, size: int = 1000, overlap: int = 200, min_chars: int = 100, *,
    content: str = "content", source: str = "source",
) -> DataFrame:
    """Plain character windows, trimmed; numbered before the short ones are dropped."""
    starts = F.sequence(F.lit(0), F.length(content) - 1, F.lit(size - overlap))
    pieces = F.transform(starts, lambda s: T.strip(F.substring(F.col(content), s + 1, F.lit(size))))
    keep = [c for c in docs.columns if c != content]
    rows = posexplode_rows(docs.where(F.length(content) > 0), keep, pieces, "chunk_index", "content")
    return rows.where(F.length("content") > min_chars)


def chapters(content: Column, book: Column) -> Column:
    """Chapters of a book as an array of (title, content, word_count).

    Inline `CHAPTER n:` headings if more than three, else the first heading pattern with at least two
    matches, else the whole book.
    """
    # mark every heading, cut at the marks: a chapter reaches to the next heading or the end, whatever its letters
    parts = F.split(F.regexp_replace(content, "(?i)" + fixed.INLINE_HEADING, "\u0001$0"), "\u0001")
    inline = let(parts, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))
    inline_rows = F.transform(
        inline,
        lambda m, i: F.struct(
            F.concat_ws(
                ": ",
                F.concat(F.lit("Chapter "), (i + 1).cast("string")),
                F.nullif(T.strip(F.regexp_extract(T.strip(m), r"(?i)^CHAPTER\s+\d+:\s*([^.\n]+)", 1)), F.lit("")),
            ).alias("title"),
            T.strip(m).alias("content"),
        ),
    )
    marked = None
    for pattern in fixed.CHAPTER_PATTERNS:
        full = "(?imd)" + pattern
        hit = F.regexp_count(content, F.lit(full)) >= 2
        text = F.regexp_replace(content, full, "\u0001$0\u0002")
        marked = F.when(hit, text) if marked is None else marked.when(hit, text)
    pieces = let(F.split(marked, "\u0001"), lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))

    def piece_row(p: Column) -> Column:
        heading, body = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return F.struct(
            T.strip(F.regexp_replace(heading, r"[*#\s]+", " ")).alias("title"),
            F.when(body == "", heading).otherwise(F.concat(heading, F.lit("\n\n"), body)).alias("content"),
        )

    halves = F.transform(pieces, lambda p: F.transform(F.split(p, "\u0002"), T.strip))
    headed = F.filter(F.transform(halves, piece_row), lambda r: T.count_words(r["content"]) > 10)
    whole = F.array(F.struct(book.alias("title"), content.alias("content")))
    chosen = F.when(F.size(inline) > 3, inline_rows).otherwise(F.coalesce(headed, whole))
    return F.transform(
        chosen,
        lambda r: F.struct(r["title"].alias("title"), r["content"].alias("content"),
                           T.count_words(r["content"]).alias("word_count")),
    )


def split_books(books: DataFrame, book: str = "book", content: str = "content") -> DataFrame:
    """One row per book with its `chapters` array."""
    keep = [c for c in books.columns if c != content]
    return books.select(*keep, chapters(F.col(content), F.col(book)).alias("chapters"))


def size_chapters(books: DataFrame, min_words: int = 1000, max_words: int = 3000) -> DataFrame:
    """Even out chapter sizes inside each book row: join short neighbours once, cut long ones at paragraphs.

    The fold sees word counts only; the parts are cut from the chapters' paragraphs in the JVM.
    """
    keep = [c for c in books.columns if c != "chapters"]
    counts = F.transform("chapters", lambda c: c["word_count"])
    rows = books.withColumn("_runs", folds.pair_runs(counts, min_words, max_words))
    rows = posexplode_rows(rows, [*keep, "chapters"], "_runs", "_order", "_run")
    pair = F.slice("chapters", F.col("_run.start"), F.col("_run.len"))
    rows = rows.select(*keep, "_order", pair.alias("_pair")).select(
        *keep,
        "_order",
        F.array_join(F.transform("_pair", lambda c: c["title"]), " & ").alias("original_chapter"),
        F.array_join(F.transform("_pair", lambda c: c["content"]), "\n\n").alias("content"),
        F.aggregate("_pair", F.lit(0), lambda a, c: a + c["word_count"]).alias("word_count"),
    )
    return split_large(rows, max_words)


def split_large(rows: DataFrame, max_words: int = 3000) -> DataFrame:
    """Cut rows above `max_words` at paragraph borders, greedily; parts are titled `(Part n)`."""
    keep = [c for c in rows.columns if c not in ("content", "word_count")]
    paragraphs = F.split("content", "\n\n")
    rows = rows.withColumn("_paras", F.when(F.col("word_count") > max_words, paragraphs))
    counts = F.transform("_paras", lambda p: T.count_words(p))
    rows = rows.withColumn("_counts", counts).withColumn("_runs", folds.pack_runs(F.col("_counts"), max_words))
    part = F.transform(
        "_runs",
        lambda r: F.struct(
            T.strip(F.array_join(F.slice("_paras", r["start"], r["len"]), "\n\n")).alias("content"),
            F.aggregate(F.slice("_counts", r["start"], r["len"]), F.lit(0), lambda a, x: a + x).alias("word_count"),
            (F.size("_runs") > 1).alias("part_of_many"),
        ),
    )
    whole = F.array(
        F.struct(F.col("content"), F.col("word_count").alias("word_count"), F.lit(False).alias("part_of_many"))
    )
    out = posexplode_rows(rows, keep, F.coalesce(part, whole), "_part", "_p").where(
        (F.col("_p.content") != "") | ~F.col("_p.part_of_many")
    )
    title = F.when(
        F.col("_p.part_of_many"),
        F.concat(F.col("original_chapter"), F.lit(" (Part "), (F.col("_part") + 1).cast("string"), F.lit(")")),
    ).otherwise(F.col("original_chapter"))
    return out.select(
        *keep, F.col("_part").alias("part"), title.alias("title"), F.col("_p.content").alias("content"),
        F.col("_p.word_count").alias("word_count"),
    )


def merge_chunks(chunks: DataFrame, max_words: int = 1000) -> DataFrame:
    """Greedy merge of a document's neighbouring chunks up to `max_words`.

    Groups are one document's chunks, so their size is bounded by the document row they came from.
    """
    item = F.struct("chunk_index", "content", "word_count", "start_word", "end_word")
    docs = chunks.groupBy("parent_source").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    docs = docs.withColumn("_runs", folds.pack_runs(F.transform("_items", lambda x: x["word_count"]), max_words))
    docs = posexplode_rows(docs, ["parent_source", "_items"], "_runs", "merged_index", "_run")
    docs = docs.withColumn("_part", F.slice("_items", F.col("_run.start"), F.col("_run.len")))
    content = F.array_join(F.transform("_part", lambda x: x["content"]), " ")
    return docs.select(
        "parent_source",
        "merged_index",
        content.alias("content"),
        F.aggregate("_part", F.lit(0), lambda a, x: a + x["word_count"]).alias("word_count"),
        F.length(content).alias("char_count"),
        F.get("_part", F.lit(0))["start_word"].alias("start_word"),
        F.element_at("_part", -1)["end_word"].alias("end_word"),
    )


def simple_paragraphs(content: Column, per_paragraph: int = 3) -> Column:
    """Paragraphs of three sentences, joined by blank lines; up to three sentences stay one paragraph."""
    def grouped(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(per_paragraph))
        return F.array_join(
            F.transform(starts, lambda i: F.array_join(F.slice(items, i, F.lit(per_paragraph)), " ")), "\n\n"
        )

    return let(T.sentences(content), grouped)


def work_list(inputs: DataFrame, done: DataFrame, key: str = "slug") -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(done.select(key), key, "left_anti")
