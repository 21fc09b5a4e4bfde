"""Registered queries: projections, filters, predicates."""

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import filters
from marginalia.plans import retrieval as P

from .base import (
    SQL_BELIEFS, SQL_CORPUS, SQL_MODELS, WS, beliefs, corpus, models, sql_strip, sql_words, table,
)

PHRASES = ["the this", "es der", "que de"]


def _q(fn):
    return lambda spark, sf: fn(corpus(spark, sf))


CHECKS = {}

CHECKS["prj_01_clean_text"] = (
    _q(lambda d: d.select("doc_id", F.md5(T.clean_text(F.col("content"))).alias("cleaned"),
                          F.md5(T.clean_text(F.concat(F.lit(" \t"), F.replace(F.col("content"), F.lit(". "), F.lit(".\r\n\n \n"))))).alias("cleaned_lines"))),
    rf"""SELECT doc_id, md5({sql_strip(f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ ]+', ' ', 'g'), '(?m)^{WS}+', '', 'g'), '(?m){WS}+$', '', 'g')")}) AS cleaned,
    md5(array_to_string(list_filter(list_transform(string_split(replace(regexp_replace(text, '[ ]+', ' ', 'g'), '. ', '.' || chr(10)), chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> ''), chr(10))) AS cleaned_lines
    FROM documents""",
)
CHECKS["prj_02_file_metadata"] = (
    _q(lambda d: d.select(
        "doc_id", F.element_at(F.split("source", "/"), -1).alias("filename"),
        T.file_suffix(F.element_at(F.split("source", "/"), -1)).alias("extension"),
        F.octet_length("content").alias("file_size"),
        T.count_words(F.col("content"), F.col("language")).alias("word_count"),
        F.length("content").alias("char_count"),
        (F.regexp_count("content", F.lit("\n")) + 1).alias("line_count"))),
    rf"""WITH {SQL_CORPUS} SELECT doc_id, string_split(source, '/')[-1] AS filename, '.txt' AS extension,
    strlen(content) AS file_size, len({sql_words('content')}) AS word_count, length(content) AS char_count,
    len(string_split(content, chr(10))) AS line_count FROM corpus""",
)
def _title_line(line):
    heading = sql_strip(f"ltrim({line}, '#')")
    shouting = f"({line} = upper({line}) AND {line} <> lower({line}))"
    capital = rf"(length({line}) - length(replace({line}, ' ', '')) < 10 AND regexp_matches({line}, '^\p{{Lu}}'))"
    return (f"CASE WHEN starts_with({line}, '#') THEN CASE WHEN length({heading}) BETWEEN 6 AND 99 THEN {heading} END "
            f"WHEN length({line}) BETWEEN 6 AND 99 AND NOT ends_with({line}, '.') AND ({shouting} OR {capital}) THEN {line} END")


CHECKS["prj_03_title"] = (
    _q(lambda d: d.select("doc_id", T.extract_title(
        F.element_at(F.split("source", "/"), -1),
        F.when(F.col("language") == "en", F.concat(F.lit("## "), F.substring_index("content", " ", 6), F.lit("\n"), F.col("content")))
        .when(F.col("language") == "fr", F.regexp_replace("content", r"([a-z])[.] ", "$1\n")).otherwise(F.col("content"))).alias("title"))),
    rf"""WITH {SQL_CORPUS}, t AS (SELECT doc_id, source, CASE language
      WHEN 'en' THEN '## ' || array_to_string(string_split(content, ' ')[1:6], ' ') || chr(10) || content
      WHEN 'fr' THEN regexp_replace(content, '([a-z])[.] ', '\1' || chr(10), 'g') ELSE content END AS content FROM corpus),
    l AS (SELECT doc_id, source, list_filter(list_transform(string_split(content, chr(10))[1:10],
      lambda x: {_title_line(sql_strip('x'))}), lambda y: y IS NOT NULL) AS c FROM t)
    SELECT doc_id, coalesce(c[1], trim(regexp_replace(replace(replace(string_split(source, '/')[-1], '.txt', ''), '_', ' '), '\d{{8}}', ''))) AS title FROM l""",
)
CHECKS["prj_04_count_words"] = (
    _q(lambda d: d.select("doc_id", T.count_words(F.col("content"), "en").alias("words"), T.count_words(F.col("content"), "zh").alias("zh_chars"),
                          T.count_words(F.lit(None).cast("string")).alias("missing"))),
    rf"SELECT doc_id, len({sql_words('text')}) AS words, length(text) AS zh_chars, 0 AS missing FROM documents",
)
CHECKS["prj_05_tokenize"] = (
    _q(lambda d: d.select("doc_id", F.md5(F.array_join(T.tokenize(F.col("content"), "en"), "|")).alias("tokens"),
                          F.md5(F.array_join(T.tokenize(F.col("content"), "zh"), "|")).alias("chars"))),
    rf"SELECT doc_id, md5(array_to_string({sql_words('text')}, '|')) AS tokens, md5(array_to_string(regexp_extract_all(text, '(?s).'), '|')) AS chars FROM documents",
)
CHECKS["prj_06_filter_documents"] = (
    _q(lambda d: filters.by_word_count(d, 10, 400, language=F.col("language"), out="w").select("doc_id", "w")),
    rf"SELECT doc_id, len({sql_words('text')}) AS w FROM documents WHERE len({sql_words('text')}) BETWEEN 10 AND 400",
)
CHECKS["prj_08_prepare_content"] = (
    _q(lambda d: d.select("doc_id", F.md5(T.prepare_content(F.col("content"), "en")).alias("one_line"), F.md5(T.prepare_content(F.replace(F.col("content"), F.lit("\n"), F.lit("\n\n\n\n")), "zh")).alias("lines"))),
    rf"SELECT doc_id, md5({sql_strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")}) AS one_line, md5({sql_strip("regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS lines FROM documents",
)
CHECKS["prj_12_browser_filter"] = (
    lambda spark, sf: filters.browse(models(spark, sf), min_confidence=0.6, categories=["en", "src3"], search="The").select("doc_id", "name"),
    SQL_MODELS + "SELECT doc_id, name FROM model_items WHERE confidence_score >= 0.6 AND list_has_any(categories, ['en', 'src3']) AND (contains(lower(name), 'the') OR contains(lower(description), 'the'))",
)
CHECKS["prj_13_remove_phrases"] = (
    _q(lambda d: d.select("doc_id", F.md5(T.remove_phrases(F.col("content"), PHRASES)).alias("cleaned"))),
    "SELECT doc_id, md5(" + sql_strip(
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)the this', '', 'g'), '(?i)es der', '', 'g'), '(?i)que de', '', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), ' {2,}', ' ', 'g')"
    ) + ") AS cleaned FROM documents",
)
CHECKS["prj_14_slugify"] = (
    _q(lambda d: d.select("doc_id", T.slugify(F.concat(F.translate("content", ".", ","), F.lit(" [50% & $"), F.col("doc_id").cast("string"), F.lit("].mp3")), 40).alias("slug"))),
    r"""WITH s AS (SELECT doc_id, lower(regexp_replace(strip_accents(replace(text, '.', ',') || ' [50% & $' || doc_id || ']'), '[^\x00-\x7f]', '', 'g')) AS t FROM documents),
    u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(replace(replace(replace(t, '$', 'dollar'), '&', 'and'), '%', 'percent'), '@', 'at'), '+', 'plus'), '/\:*?"<>|()[]{}#=!~`^', '______________________'), '[\s\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM s)
    SELECT doc_id, CASE WHEN length(t) > 40 THEN regexp_replace(substring(t, 1, 40), '_+$', '') WHEN t = '' THEN 'transcript' ELSE t END AS slug FROM u""",
)
CHECKS["prj_15_persona_id"] = (
    _q(lambda d: d.withColumn("n", F.concat(F.lit("  "), F.col("content"), F.lit("'s! "), F.col("persona_id"))).select(
        "doc_id", T.persona_id(F.col("n")).alias("pid"), T.persona_slug(T.persona_id(F.col("n"))).alias("slug"),
        T.persona_slug(F.col("persona_id"), {"src1": "first-source"}).alias("known_slug"),
        T.persona_display(F.concat(F.col("persona_id"), F.lit("_host"))).alias("display"))),
    rf"""WITH n AS (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({sql_strip("'  ' || text || '''s! ' || source")}), '{WS}+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS pid FROM documents)
    SELECT doc_id, pid, replace(pid, '_', '-') AS slug, CASE source WHEN 'src1' THEN 'first-source' ELSE source END AS known_slug,
      upper(substring(source, 1, 1)) || substring(source, 2) || ' Host' AS display FROM n""",
)
CHECKS["prj_17_split_delimited"] = (
    _q(lambda d: d.select("doc_id", F.array_join(T.split_delimited(F.replace(F.col("content"), F.lit(". "), F.lit(".\n \n")), "\n"), "¦").alias("lines"),
                          F.size(T.split_delimited(F.translate("content", ",", "|"), "|")).alias("parts"))),
    rf"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> ''), '¦') AS lines,
    len(list_filter(list_transform(string_split(replace(text, ',', '|'), '|'), lambda s: {sql_strip('s')}), lambda s: s <> '')) AS parts FROM documents""",
)
CHECKS["prj_18_format_lists"] = (
    lambda spark, sf: models(spark, sf).select(
        "doc_id", T.numbered(F.col("steps"), "No steps available").alias("steps_text"),
        T.bulleted(F.col("steps"), "No supporting evidence available").alias("bullets"),
        T.comma_list(F.col("categories"), "Uncategorized").alias("cats")),
    SQL_MODELS + """SELECT doc_id, CASE WHEN len(steps) = 0 THEN 'No steps available' ELSE array_to_string(list_transform(steps, lambda s, i: i || '. ' || s), chr(10)) END AS steps_text,
    CASE WHEN len(steps) = 0 THEN 'No supporting evidence available' ELSE array_to_string(list_transform(steps, lambda s: '• ' || s), chr(10)) END AS bullets,
    array_to_string(categories, ', ') AS cats FROM model_items""",
)
CHECKS["prj_19_confidence_level"] = (
    lambda spark, sf: table(spark, sf, "events").select("event_id", T.confidence_level(F.col("value") / 100).alias("level")),
    "SELECT event_id, CASE WHEN value/100 >= .9 THEN 'Very High' WHEN value/100 >= .8 THEN 'High' WHEN value/100 >= .7 THEN 'Medium' WHEN value/100 >= .6 THEN 'Low' ELSE 'Very Low' END AS level FROM events",
)
CHECKS["prj_20_excerpt_preview"] = (
    _q(lambda d: d.select("doc_id", F.md5(T.excerpt_preview(F.col("content"), 300)).alias("preview"))),
    rf"""SELECT doc_id, md5(CASE WHEN length(text) <= 600 THEN 'FULL CONTENT: "' || {sql_strip('text')} || '"'
    ELSE 'BEGINNING: "' || {sql_strip('left(text, 300)')} || '..."' || chr(10) || '[...MIDDLE CONTENT OMITTED...]' || chr(10) || 'ENDING: "...' || {sql_strip('right(text, 300)')} || '"' END) AS preview FROM documents""",
)
CHECKS["prj_21_hide_evidence"] = (
    lambda spark, sf: P.hide_evidence(beliefs(spark, sf))
    .select("doc_id", "statement", F.size("supporting_evidence").alias("evidence_count")),
    SQL_BELIEFS + "SELECT doc_id, statement, 0 AS evidence_count FROM belief_items",
)
CHECKS["prj_22_by_category"] = (
    lambda spark, sf: filters.in_category(models(spark, sf), "SRC4").select("doc_id", "name"),
    SQL_MODELS + "SELECT doc_id, name FROM model_items WHERE len(list_filter(categories, lambda x: lower(x) = 'src4')) > 0",
)
CHECKS["prj_23_conversation_history"] = (
    lambda spark, sf: filters.conversation(table(spark, sf, "conversations"), 3).select("turn", "role", "text"),
    "SELECT turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn",
)
