"""Registered queries: chunkers."""

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import chunking as C
from marginalia.operators import filters

from .base import (
    SQL_CORPUS, corpus, sql_chunks, sql_pack, sql_sentences, sql_strip, sql_words, table,
)

CHECKS = {}
CORPUS_CHUNKS = f"WITH {SQL_CORPUS}, {sql_chunks(100, 20)} "


def chunks(spark, sf, size=100, overlap=20):
    return C.word_chunks(corpus(spark, sf), size, overlap)


CHECKS["chk_01_word_windows"] = (
    lambda spark, sf: chunks(spark, sf).select("doc_id", "chunk_index", "total_chunks", "start_word", "end_word", F.md5("content").alias("content")),
    CORPUS_CHUNKS + "SELECT doc_id, chunk_index, total_chunks, start_word, end_word, md5(content) AS content FROM chunks",
)
CHECKS["chk_01_default_sizes"] = (
    lambda spark, sf: chunks(spark, sf, 500, 100).select("doc_id", "chunk_index", "total_chunks", "word_count", F.md5("content").alias("content")),
    f"WITH {SQL_CORPUS}, {sql_chunks(500, 100)} SELECT doc_id, chunk_index, total_chunks, word_count, md5(content) AS content FROM chunks",
)
CHECKS["chk_01_no_contained_tail"] = (
    lambda spark, sf: C.word_chunks(corpus(spark, sf), 100, 20, drop_contained_tail=True).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end_word").alias("last_word")),
    CORPUS_CHUNKS + "SELECT doc_id, count(*) AS n, max(end_word) AS last_word FROM chunks WHERE start_word = 0 OR start_word + 20 < (SELECT max(end_word) FROM chunks c2 WHERE c2.doc_id = chunks.doc_id) GROUP BY doc_id",
)
CHECKS["prj_09_chunk_rows"] = (
    lambda spark, sf: chunks(spark, sf).select("chunk_id", "source", "parent_source", "persona_id", "word_count", "char_count", "is_chunk"),
    CORPUS_CHUNKS + "SELECT chunk_id, source, parent_source, persona_id, word_count, length(content) AS char_count, true AS is_chunk FROM chunks",
)
CHECKS["prj_07_filter_chunks"] = (
    lambda spark, sf: filters.chunks_by_size(chunks(spark, sf), 10, 2000).select("chunk_id", "word_count"),
    CORPUS_CHUNKS + "SELECT chunk_id, word_count FROM chunks WHERE word_count BETWEEN 10 AND 2000",
)
CHECKS["chk_02_split_documents"] = (
    lambda spark, sf: C.split_documents(corpus(spark, sf), 500, 100).select("source", "language", "chunk_index", "total_chunks", "is_chunk", "start_word"),
    f"""WITH {SQL_CORPUS}, {sql_chunks(500, 100)} SELECT CASE WHEN total_chunks = 1 THEN parent_source ELSE source END AS source, language,
    chunk_index, total_chunks, total_chunks > 1 AS is_chunk, start_word FROM chunks""",
)
CHECKS["chk_03_segment_windows"] = (
    lambda spark, sf: C.segment_chunks(corpus(spark, sf).withColumn("seg", T.words(F.col("content"))), "seg", 500, 100).select(
        "doc_id", "chunk_index", "total_chunks", "start_word", "end_word", F.md5("content").alias("content")),
    rf"""WITH {SQL_CORPUS}, w AS (SELECT doc_id, content, {sql_words('content')} AS seg, len({sql_words('content')}) AS n FROM corpus WHERE length(content) > 0),
    c AS (SELECT *, length(content) <= 500 OR n <= 250 AS single FROM w),
    s AS (SELECT *, unnest(CASE WHEN single THEN [0] ELSE generate_series(0, (ceil((n - 250) / 200.0)::INT) * 200, 200) END) AS st FROM c)
    SELECT doc_id, st // 200 AS chunk_index, CASE WHEN single THEN 1 ELSE 1 + ceil((n - 250) / 200.0)::INT END AS total_chunks, st AS start_word,
      CASE WHEN single THEN n ELSE least(st + 250, n) END AS end_word,
      md5(CASE WHEN single THEN content ELSE array_to_string(seg[st + 1:st + 250], '') END) AS content FROM s""",
)
CHECKS["chk_04_char_windows"] = (
    lambda spark, sf: C.char_chunks(corpus(spark, sf), 500, 100).select("doc_id", "chunk_index", "start_word", "end_word", F.md5("content").alias("content")),
    rf"""WITH RECURSIVE {SQL_CORPUS}, t AS (SELECT doc_id, content, length(content) AS n, translate(content, chr(10) || chr(9) || chr(12288), '   ') AS flat FROM corpus WHERE length(content) > 0),
    r AS (SELECT doc_id, 0 AS i, 0 AS st, CASE WHEN least(500, n) < n AND contains(substring(flat, 401, 100), ' ') THEN 400 + 101 - strpos(reverse(substring(flat, 401, 100)), ' ') ELSE least(500, n) END AS en FROM t
      UNION ALL SELECT doc_id, i + 1, ns, CASE WHEN least(ns + 500, n) < n AND contains(substring(flat, ns + 401, 100), ' ') THEN ns + 400 + 101 - strpos(reverse(substring(flat, ns + 401, 100)), ' ') ELSE least(ns + 500, n) END
      FROM (SELECT r.*, n, flat, en - 100 AS ns0, CASE WHEN en - 100 > st THEN en - 100 ELSE st + 250 END AS ns FROM r JOIN t USING (doc_id)) WHERE ns < n)
    SELECT doc_id, i AS chunk_index, st AS start_word, en AS end_word, md5(substring(content, st + 1, en - st)) AS content FROM r JOIN t USING (doc_id)""",
)
CHECKS["chk_05_fixed_char_windows"] = (
    lambda spark, sf: C.fixed_char_chunks(corpus(spark, sf)).select("doc_id", "chunk_index", F.md5("content").alias("content")),
    rf"""WITH {SQL_CORPUS}, s AS (SELECT doc_id, content AS c, unnest(generate_series(0, length(content) - 1, 800)) AS st FROM corpus WHERE length(content) > 0)
    SELECT doc_id, st // 800 AS chunk_index, md5({sql_strip('substring(c, st + 1, 1000)')}) AS content FROM s WHERE length({sql_strip('substring(c, st + 1, 1000)')}) > 100""",
)


def books(spark, sf):
    """Books made of the documents: every fifth sentence opens a chapter, headed as its language does."""
    s = T.sentences(F.col("content"))

    def line(x, i):
        k = (i / 5 + 1).cast("int").cast("string")
        head = (F.when(F.col("language") == "en", F.concat(F.lit("Chapter "), k, F.lit(" Part")))
                .when(F.col("language") == "fr", F.concat(F.lit("Appendix A"), k))
                .when(F.col("language") == "de", F.concat(F.lit("## CHAPTER *"), k, F.lit("*"))))
        return F.when((i % 5 == 0) & head.isNotNull(), F.concat(head, F.lit("\n\n"), x)).otherwise(x)

    return corpus(spark, sf).select("doc_id", F.concat(F.lit("book_"), F.col("doc_id").cast("string")).alias("book"), "language",
                                    F.array_join(F.transform(s, line), "\n\n").alias("content"))


_HEAD = """CASE language WHEN 'en' THEN 'Chapter ' || ((i - 1) // 5 + 1) || ' Part' WHEN 'fr' THEN 'Appendix A' || ((i - 1) // 5 + 1)
  WHEN 'de' THEN '## CHAPTER *' || ((i - 1) // 5 + 1) || '*' END"""
_PAT = r"""CASE language WHEN 'en' THEN '(?im)^\s*Chapter\s+[\dIVXLCDM]+.*$' WHEN 'fr' THEN '(?im)^\s*Appendix\s+[A-Z\d]+.*$' ELSE '(?im)^#{1,3}\s+Chapter.*$' END"""
SQL_BOOKS = rf"""{SQL_CORPUS}, books AS (SELECT doc_id, 'book_' || doc_id AS book, language, array_to_string(list_transform({sql_sentences('content')},
    lambda s, i: CASE WHEN (i - 1) % 5 = 0 AND language <> 'es' THEN {_HEAD} || chr(10) || chr(10) || s ELSE s END), chr(10) || chr(10)) AS content FROM corpus),
  marked AS (SELECT doc_id, book, content, CASE WHEN language = 'en' THEN regexp_replace(content, '(?im)^\s*Chapter\s+[\dIVXLCDM]+.*$', chr(1) || '\0' || chr(2), 'g')
      WHEN language = 'fr' THEN regexp_replace(content, '(?im)^\s*Appendix\s+[A-Z\d]+.*$', chr(1) || '\0' || chr(2), 'g')
      WHEN language = 'de' THEN regexp_replace(content, '(?im)^#{{1,3}}\s+Chapter.*$', chr(1) || '\0' || chr(2), 'g') ELSE content END AS m FROM books),
  pieces AS (SELECT doc_id, book, len(string_split(m, chr(1))) - 1 AS k, content, string_split(m, chr(1)) AS p FROM marked),
  split AS (SELECT doc_id, book, CASE WHEN k >= 2 THEN list_filter(list_transform(p[2:], lambda x: {{'title': trim(regexp_replace({sql_strip("string_split(x, chr(2))[1]")}, '[*#\s]+', ' ', 'g')),
      'content': {sql_strip("string_split(x, chr(2))[1]")} || chr(10) || chr(10) || {sql_strip("string_split(x, chr(2))[2]")}}}), lambda r: len({sql_words("r['content']")}) > 10)
    ELSE [{{'title': book, 'content': content}}] END AS ch FROM pieces),
  counted AS (SELECT doc_id, book, ch, list_transform(ch, lambda r: len({sql_words("r['content']")})) AS counts FROM split)"""
CHECKS["chk_06_chapters"] = (
    lambda spark, sf: C.split_books(books(spark, sf)).select("doc_id", F.posexplode_outer("chapters").alias("i", "c")).where("i IS NOT NULL").select(
        "doc_id", "i", F.col("c.title").alias("title"), F.col("c.word_count").alias("word_count"), F.md5("c.content").alias("content")),
    f"""WITH {SQL_BOOKS}, e AS (SELECT doc_id, unnest(generate_series(1, len(ch))) AS j, ch, counts FROM counted)
    SELECT doc_id, j - 1 AS i, ch[j]['title'] AS title, counts[j] AS word_count, md5(ch[j]['content']) AS content FROM e""",
)
_INLINE_SPARK = lambda d: d.select("doc_id", F.concat(F.lit("book_"), F.col("doc_id").cast("string")).alias("book"), F.array_join(F.transform(
    T.sentences(F.col("content")), lambda s, i: F.concat(F.lit("CHAPTER "), (i + 1).cast("string"), F.lit(": "), s)), " ").alias("content"))
CHECKS["chk_07_inline_chapters"] = (
    lambda spark, sf: C.split_books(_INLINE_SPARK(corpus(spark, sf))).select("doc_id", F.posexplode_outer("chapters").alias("i", "c")).where("i IS NOT NULL").select(
        "doc_id", "i", F.col("c.title").alias("title"), F.md5("c.content").alias("content")),
    rf"""WITH {SQL_CORPUS}, s AS (SELECT doc_id, {sql_sentences('content')} AS ss FROM corpus),
    b AS (SELECT doc_id, array_to_string(list_transform(ss, lambda s, i: 'CHAPTER ' || i || ': ' || s), ' ') AS book, list_transform(ss, lambda s, i: 'CHAPTER ' || i || ': ' || s) AS p, len(ss) AS n FROM s),
    e AS (SELECT doc_id, unnest(CASE WHEN n > 3 THEN p WHEN n > 0 THEN [book] ELSE [''] END) AS c, unnest(generate_series(1, CASE WHEN n > 3 THEN n ELSE 1 END)) AS j, n FROM b)
    SELECT doc_id, j - 1 AS i, CASE WHEN n > 3 THEN concat_ws(': ', 'Chapter ' || j, nullif({sql_strip(r"regexp_extract(c, '(?i)^CHAPTER\s+\d+:\s*([^.\n]+)', 1)")}, '')) ELSE 'book_' || doc_id END AS title, md5(c) AS content FROM e""",
)
_SIZED = C.size_chapters
_REC = f"""WITH RECURSIVE {SQL_BOOKS}, pairs AS (
      SELECT doc_id, counts, 1 AS i, 0 AS ord, CASE WHEN counts[1] < 60 AND len(counts) > 1 AND counts[1] + counts[2] <= 120 THEN 2 ELSE 1 END AS n FROM counted WHERE len(counts) > 0
      UNION ALL SELECT doc_id, counts, i + n, ord + 1, CASE WHEN counts[i + n] < 60 AND i + n < len(counts) AND counts[i + n] + counts[i + n + 1] <= 120 THEN 2 ELSE 1 END FROM pairs WHERE i + n <= len(counts)),
    sized AS (SELECT p.doc_id, ord, CASE WHEN n = 2 THEN ch[i]['title'] || ' & ' || ch[i + 1]['title'] ELSE ch[i]['title'] END AS original,
      CASE WHEN n = 2 THEN ch[i]['content'] || chr(10) || chr(10) || ch[i + 1]['content'] ELSE ch[i]['content'] END AS content,
      CASE WHEN n = 2 THEN c.counts[i] + c.counts[i + 1] ELSE c.counts[i] END AS wc FROM pairs p JOIN counted c USING (doc_id))"""
CHECKS["chk_09_size_chapters"] = (
    lambda spark, sf: C.size_chapters(C.split_books(books(spark, sf)), 60, 120).groupBy("doc_id", "_order").agg(
        F.max("original_chapter").alias("original"), F.sum("word_count").alias("word_count"), F.count("*").alias("parts")).withColumnRenamed("_order", "ord"),
    _REC + rf""", paras AS (SELECT doc_id, ord, original, wc, list_transform(string_split(content, chr(10) || chr(10)), lambda p: len({sql_words('p')})) AS counts FROM sized),
      {sql_pack('packed', '(SELECT doc_id * 100000 + ord AS k, counts FROM paras WHERE wc > 120)', 'k', 120)}
    SELECT doc_id, ord, original, list_sum(paras.counts)::BIGINT AS word_count, coalesce(max(grp) + 1, 1) AS parts FROM paras LEFT JOIN packed ON k = doc_id * 100000 + ord GROUP BY ALL""",
)
CHECKS["chk_08_split_large"] = (
    lambda spark, sf: C.size_chapters(C.split_books(books(spark, sf)), 60, 120).where(F.col("title") != F.col("original_chapter")).select(
        "doc_id", F.col("_order").alias("ord"), "part", "title", "word_count", F.md5("content").alias("content")),
    _REC + rf""", paras AS (SELECT doc_id, ord, original, wc, string_split(content, chr(10) || chr(10)) AS ps FROM sized WHERE wc > 120),
      pc AS (SELECT doc_id * 100000 + ord AS k, list_transform(ps, lambda p: len({sql_words('p')})) AS counts FROM paras),
      {sql_pack('packed', 'pc', 'k', 120)},
      runs AS (SELECT k, grp, min(i) AS a, max(i) AS b, sum(counts[i])::BIGINT AS wc FROM packed GROUP BY ALL)
    SELECT doc_id, ord, grp AS part, original || ' (Part ' || (grp + 1) || ')' AS title, runs.wc AS word_count, md5({sql_strip("array_to_string(ps[a:b], chr(10) || chr(10))")}) AS content
    FROM runs JOIN paras ON k = doc_id * 100000 + ord WHERE (SELECT max(grp) FROM runs r WHERE r.k = runs.k) > 0""",
)
CHECKS["chk_10_merge_chunks"] = (
    lambda spark, sf: C.merge_chunks(chunks(spark, sf), 250).select("parent_source", "merged_index", "word_count", "char_count", "start_word", "end_word", F.md5("content").alias("content")),
    f"""WITH RECURSIVE {SQL_CORPUS}, {sql_chunks(100, 20)}, d AS (SELECT parent_source, list(word_count ORDER BY chunk_index) AS counts, list(content ORDER BY chunk_index) AS cs,
      list(start_word ORDER BY chunk_index) AS ss, list(end_word ORDER BY chunk_index) AS es FROM chunks GROUP BY parent_source),
      {sql_pack('packed', 'd', 'parent_source', 250)}, runs AS (SELECT parent_source, grp, min(i) AS a, max(i) AS b, sum(counts[i])::BIGINT AS wc FROM packed GROUP BY ALL)
    SELECT parent_source, grp AS merged_index, wc AS word_count, length(array_to_string(cs[a:b], ' ')) AS char_count, ss[a] AS start_word, es[b] AS end_word,
      md5(array_to_string(cs[a:b], ' ')) AS content FROM runs JOIN d USING (parent_source)""",
)
CHECKS["chk_12_simple_paragraphs"] = (
    lambda spark, sf: corpus(spark, sf).select("doc_id", F.md5(C.simple_paragraphs(F.col("content"))).alias("formatted")),
    rf"""WITH {SQL_CORPUS}, s AS (SELECT doc_id, {sql_sentences('content')} AS ss FROM corpus)
    SELECT doc_id, md5(array_to_string(list_transform(generate_series(1, greatest(len(ss), 1), 3), lambda i: array_to_string(ss[i:i + 2], ' ')), chr(10) || chr(10))) AS formatted FROM s""",
)
CHECKS["chk_13_work_list"] = (
    lambda spark, sf: C.work_list(
        corpus(spark, sf).withColumn("slug", T.slugify(F.col("source"))),
        corpus(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(T.slugify(F.col("source")).alias("slug"))).select("doc_id", "slug"),
    f"""WITH {SQL_CORPUS} SELECT doc_id, persona_id || '_doc_' || lpad(doc_id::VARCHAR, 9, '0') AS slug FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
CHECKS["chk_13_batch_counters"] = (
    lambda spark, sf: filters.batch_counters(corpus(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left"), filters.outcome(F.col("toxic") == 1, F.col("quality").isNotNull())),
    "SELECT CASE WHEN toxic = 1 THEN 'failed' WHEN quality IS NOT NULL THEN 'skipped' ELSE 'processed' END AS status, count(*) AS files FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
