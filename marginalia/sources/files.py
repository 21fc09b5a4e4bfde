"""Text files, books, URL lists and media listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import chunking


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1 (which every byte string is)."""
    as_text = content.cast("string")
    text = F.when(F.is_valid_utf8(as_text), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def read_text_files(
    spark: SparkSession, paths: str | list[str], *, pattern: str | None = None, recursive: bool = False,
    language: str = "en", keep_paragraphs: bool = False,
) -> DataFrame:
    """One cleaned row per readable, non-empty text file, with its metadata and title.

    Missing and unreadable files are skipped. File listing and reading are distributed by the source.
    """
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = T.file_suffix(name)
    raw = files.where(suffix.isin(fixed.TEXT_SUFFIXES) & (F.col("length") > 0)).select(
        F.col("path").alias("source"), name.alias("filename"), suffix.alias("extension"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"), T.clean_text(decode_text(F.col("content")), keep_paragraphs).alias("content"),
    )
    return _with_metadata(raw, language).where(F.col("content") != "")


def _with_metadata(raw: DataFrame, language: str) -> DataFrame:
    lang = F.lit(language)
    return raw.withColumns({
        "language": lang,
        "word_count": T.count_words(F.col("content"), lang),
        "char_count": F.length("content"),
        "line_count": F.regexp_count("content", F.lit("\n")) + 1,
        "title": T.extract_title(F.col("filename"), F.col("content")),
    })


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths of an explicit list that are there; the list comes from the caller, so it is small."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, h in zip(paths, hadoop) if h.getFileSystem(conf).exists(h)]


def read_text_list(spark: SparkSession, paths: list[str], **kw) -> DataFrame:
    """An explicit list of files; missing ones are dropped."""
    return read_text_files(spark, existing_paths(spark, paths), **kw)


def book_chunks(books: DataFrame, *, min_words: int = 1000, max_words: int = 3000) -> DataFrame:
    """Numbered chunks of every book (book, content): (book, chunk_number, file_name, title, content, word_count)."""
    sized = chunking.size_chapters(chunking.split_books(books.select("book", "content")), min_words, max_words)
    position = F.array_sort(F.collect_list(F.struct("_order", "part", "title", "content", "word_count")))
    rows = sized.groupBy("book").agg(position.alias("_c")).select("book", F.posexplode("_c").alias("_p", "c"))
    return rows.select(
        "book", (F.col("_p") + 1).alias("chunk_number"), F.format_string("%s_chunk_%03d.md", "book", F.col("_p") + 1).alias("file_name"),
        "c.title", "c.content", "c.word_count",
    )


def write_book_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Write one folder per chunk file name and give the counts per book."""
    chunks.select("book", "file_name", F.col("content").alias("value")).write.mode("overwrite").partitionBy("book", "file_name").text(path)
    return chunks.groupBy("book").agg(F.count("*").alias("total_chunks"), F.sum("word_count").alias("total_words"))


def read_url_list(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(usable video URLs, rejected lines); blank lines and comments are neither."""
    line = T.strip(F.col(column))
    rows = lines.withColumn("url", line).where((F.col("url") != "") & ~F.col("url").startswith("#"))
    good = F.contains("url", F.lit("youtube.com/watch")) | F.contains("url", F.lit("youtu.be/"))
    return rows.where(good), rows.where(~good)


def visible_files(files: DataFrame, extensions: list[str], path: str = "path") -> DataFrame:
    """Files with a wanted extension that are neither hidden nor left by an operating system, by path."""
    name = F.element_at(F.split(path, "/"), -1)
    return files.where(
        ~name.startswith(".") & ~name.isin(fixed.SYSTEM_FILES) & T.file_suffix(name).isin([e.lower() for e in extensions])
    ).orderBy(path)
