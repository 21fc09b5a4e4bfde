"""Shared inputs of the registered queries and the matching SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.session import small_batches, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents as the engine's corpus: tenant = source column, path-like source."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        "doc_id",
        F.col("source").alias("persona_id"),
        F.concat(F.col("source"), F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("source"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
    )


SQL_CORPUS = """corpus AS (
  SELECT doc_id, source AS persona_id, source || '/doc_' || lpad(doc_id::VARCHAR, 9, '0') || '.txt' AS source,
         lang AS language, text AS content FROM documents)"""

WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
NWS = r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def sql_words(c: str) -> str:
    return f"regexp_extract_all({c}, '{NWS}+')"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_tokens(c: str) -> str:
    return r"regexp_extract_all(lower(" + c + r"), '[\p{L}\p{N}_]{2,}')"


def sql_sentences(c: str) -> str:
    cut = r"string_split(regexp_replace(" + c + r", '([.!?])[ \t\r\n\x0b\f]+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_alpha(c: str) -> str:
    return (r"list_filter(regexp_extract_all(" + c + r", '[\p{L}\p{N}_]+'), "
            r"lambda w: regexp_full_match(w, '\p{L}+'))")


def sql_class(c: str, rules, default: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({c}, '{n}')" for n in needles) + f" THEN '{name}'"
        for name, needles in rules
    )
    return f"CASE {arms} ELSE {default} END"


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def queries_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


SQL_QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", (0.5 + 0.5 * F.col("quality")).alias("confidence_score"))


def _with_confidence(docs: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return (
        docs.join(confidence(spark, sf), "doc_id", "left")
        .withColumn("confidence_score", F.coalesce("confidence_score", F.lit(0.5)))
        .withColumn("frequency", (F.col("doc_id") % 10 + 1).cast("int"))
    )


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Mental-model records derived from the documents, one per document."""
    s = T.sentences(F.col("content"))
    docs = corpus(spark, sf).select(
        "doc_id", "persona_id", "language",
        F.array_join(F.slice(T.words(F.col("content")), 1, 5), " ").alias("name"),
        F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("description"),
        F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))).alias("steps"),
        F.array("language", "persona_id").alias("categories"),
    )
    return _with_confidence(docs, spark, sf)


def beliefs(spark: SparkSession, sf: str) -> DataFrame:
    """Core-belief records derived from the documents, one per document."""
    s = T.sentences(F.col("content"))
    docs = corpus(spark, sf).select(
        "doc_id", "persona_id", "language",
        F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("statement"),
        F.col("persona_id").alias("category"),
        F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))).alias("supporting_evidence"),
    )
    return _with_confidence(docs, spark, sf)


_SENT = sql_sentences("content")
_CONF = """coalesce(0.5 + 0.5 * quality, 0.5)::DOUBLE AS confidence_score, (doc_id % 10 + 1)::BIGINT AS frequency
  FROM corpus LEFT JOIN labels USING (doc_id)"""
SQL_MODELS_CTE = rf"""{SQL_CORPUS}, model_items AS (SELECT doc_id, persona_id, language,
  array_to_string(({sql_words('content')})[1:5], ' ') AS name, coalesce(({_SENT})[1], '') AS description,
  ({_SENT})[2:] AS steps, [language, persona_id] AS categories, {_CONF})"""
SQL_BELIEFS_CTE = rf"""{SQL_CORPUS}, belief_items AS (SELECT doc_id, persona_id, language,
  coalesce(({_SENT})[1], '') AS statement, persona_id AS category, ({_SENT})[2:] AS supporting_evidence, {_CONF})"""
SQL_MODELS = f"WITH {SQL_MODELS_CTE} "
SQL_BELIEFS = f"WITH {SQL_BELIEFS_CTE} "


def sql_chunks(size: int = 100, overlap: int = 20, src: str = "corpus", name: str = "chunks") -> str:
    """CTEs giving the word windows of `src`."""
    step = max(size - overlap, 1)
    return rf"""{name}_w AS (SELECT doc_id, persona_id, source, language, {sql_words('content')} AS words, len({sql_words('content')}) AS n FROM {src}),
  {name}_s AS (SELECT *, unnest(CASE WHEN n <= {size} THEN [0] ELSE generate_series(0, n - 1, {step}) END) AS start_word FROM {name}_w WHERE n > 0),
  {name} AS (SELECT doc_id, persona_id, language, source AS parent_source, start_word, least(start_word + {size}, n) AS end_word,
    start_word // {step} AS chunk_index, CASE WHEN n <= {size} THEN 1 ELSE (n + {step} - 1) // {step} END AS total_chunks,
    source || '#chunk_' || (start_word // {step}) AS source, sha256(source || '#' || (start_word // {step})) AS chunk_id,
    array_to_string(words[start_word + 1:start_word + {size}], ' ') AS content, least(start_word + {size}, n) - start_word AS word_count FROM {name}_s)"""


def sql_pack(name: str, src: str, key: str, limit: int, max_items: int | None = None) -> str:
    """Recursive CTE `name(key, i, grp)`: greedy packing of the list column `counts` of `src`."""
    full = f"OR size >= {max_items}" if max_items else ""
    return f"""{name} AS (
      SELECT {key}, counts, 1 AS i, 0 AS grp, counts[1]::BIGINT AS total, 1 AS size FROM {src} WHERE len(counts) > 0
      UNION ALL
      SELECT {key}, counts, i + 1, CASE WHEN total + counts[i + 1] > {limit} {full} THEN grp + 1 ELSE grp END,
        CASE WHEN total + counts[i + 1] > {limit} {full} THEN counts[i + 1] ELSE total + counts[i + 1] END,
        CASE WHEN total + counts[i + 1] > {limit} {full} THEN 1 ELSE size + 1 END
      FROM {name} WHERE i < len(counts))"""
