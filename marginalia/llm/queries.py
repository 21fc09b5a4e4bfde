"""The registered query of each operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontaminate, exact_dedup, html_text, language, lexical_search, line_dedup, near_dedup, packing, quality, sharding, toxicity, whitening
from marginalia.llm.common import crc_mod, table
from marginalia.llm.sql import SQL

LANG_HELD_OUT = 1
FOLDS = 5


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_repeated_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", FOLDS) != 0), "quality")
    return _judged(quality.score(docs, machine), 0.3)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(crc_mod("doc_id", 3) != LANG_HELD_OUT))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == LANG_HELD_OUT).alias("held_out"), "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_text.extract(pages, html_text.fit(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    n_hit = decontaminate.hits("spans")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    size = F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 32
    out = sharding.kd_shards(docs, {"source": sharding.name_value("source"), "lang": sharding.name_value("lang"), "size": size}, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"), words=5, percent=75)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", FOLDS) != 0), "toxic")
    return _judged(toxicity.score(docs, model), 0.5)


def op11_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, window=4096, end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lexical_search.rank_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=50)
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = whitening.fit(vectors, components=32)
    error = whitening.identity_error(vectors, fitted)
    shares = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values]) if len(fitted.values) else F.array().cast("array<double>")
    rows = whitening.whiten(vectors, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def _judged(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_byte_bpe, op3_quality, op4_language_id, op5_html_text, op6_decontaminate, op7_kd_shards, op8_exact_dedup,
    op9_minhash_near_dedup, op10_toxicity, op11_lexical_packing, op12_lexical_search, op13_embedding_whitening)}
CHECKS = {name: (fn, SQL.get(name)) for name, fn in QUERIES.items()}
