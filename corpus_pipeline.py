"""From raw documents to token ids: language ID, line dedup, near dedup, decontamination, byte-level BPE.

Every stage reads what its predecessor wrote. All but the last return the columns of documents, whatever their names.

In every stage: null and empty texts have no lines, words or tokens to act on (the first stage rejects them, as they hold no
letter); texts are read whole, however long; equal rows fare alike, rows that share an id but not the text do not;
ties go to the smaller id; a table without rows gives one without rows.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontaminate, language, line_dedup, near_dedup
from marginalia.llm.common import crc_mod, stored, table
from marginalia.session import ship_packages

#: A document is rejected when no letter is in it or less than this share of its words looks like the languages learnt.
LEAST_FAMILIAR = 0.2


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """`docs` with private names for all columns but those in `used`, so that no operator's column can replace one."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in used else f"_kept{i}") for i, c in enumerate(docs.columns)])


def _columns(out: DataFrame, docs: DataFrame, *used: str, new_text: bool = True) -> DataFrame:
    """The columns of `docs` again; n_chars, where present, follows the new text."""
    kept = [F.col(c if c in used else f"_kept{i}").alias(c) for i, c in enumerate(docs.columns)]
    if new_text and "n_chars" in docs.columns:
        kept[docs.columns.index("n_chars")] = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*kept)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learnt from two thirds of the given documents."""
    model = language.fit(docs.filter(crc_mod("doc_id", 3) != 1))
    found = language.predict(_apart(docs, "text"), model)
    return _columns(found.filter((F.col("lang_pred") != "und") & (F.col("familiar") >= LEAST_FAMILIAR)), docs, "text", new_text=False)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents lose all their copies."""
    out = line_dedup.drop_repeated_lines(_apart(docs, "doc_id", "text"), min_docs=10, min_chars=1)
    return _columns(out, docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return near_dedup.drop_near_copies(docs).select(*docs.columns)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    return _columns(decontaminate.remove_contamination(_apart(docs, "text"), table(spark, sf_dir, "benchmark")), docs, "text")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded once more to prove the round trip."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return tokens.select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _ready(stage):
    """`stage` with the package on the executors and small Arrow batches, as some texts are very long."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_packages(spark, os.path.join(os.path.dirname(os.path.abspath(__file__)), "marginalia"))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _ready(keep_known_languages)),
    ("line_dedup", _ready(drop_repeated_lines)),
    ("near_dedup", _ready(drop_near_copies)),
    ("decontaminate", _ready(cut_benchmark_passages)),
    ("byte_bpe", _ready(to_tokens)),
]

#: Learnt models and byte-pair merges have no SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
